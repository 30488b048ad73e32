"""Spark-native analytics over source trees, tables and event streams."""

__version__ = "0.1.0"
