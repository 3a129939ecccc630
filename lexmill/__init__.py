"""lexmill: a Spark-native engine that discovers domain vocabulary in raw text."""

__version__ = "0.1.0"
