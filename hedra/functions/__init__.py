"""Expressions: parsing, transforms and rules."""
