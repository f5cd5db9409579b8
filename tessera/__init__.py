"""Spark-native retrieval and text analytics over source-code collections."""

__version__ = "0.1.0"
