"""textloom: a Spark-native engine for text as a signal."""

__version__ = "0.1.0"
