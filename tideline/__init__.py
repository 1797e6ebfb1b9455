"""Spark-native analytics over order books, trades, fills and large record stores."""

__version__ = "0.1.0"
