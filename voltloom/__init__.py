"""Spark-native analytics for multichannel voltage recordings and event trains."""

__version__ = "0.1.0"
