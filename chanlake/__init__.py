"""Spark-native analytics for collected public-channel messages."""

__version__ = "0.1.0"
