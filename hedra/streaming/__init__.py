"""Structured Streaming entry points (an extension: nothing is stateful)."""
