"""Spark-native Korean text analysis, product-name analysis and boolean text search."""

__version__ = "0.1.0"
