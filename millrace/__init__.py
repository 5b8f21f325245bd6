"""millrace: a Spark-native engine for querying and reshaping files and tables."""

__version__ = "0.1.0"
