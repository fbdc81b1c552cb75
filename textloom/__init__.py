"""textloom: a Spark-native engine for full-text search and text data processing."""

__version__ = "0.1.0"
