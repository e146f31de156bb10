"""hedra: a Spark-native engine for statistical property-valuation analytics."""

__version__ = "0.1.0"
