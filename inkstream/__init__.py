"""inkstream: a Spark-native engine for curating article text at scale."""

__version__ = "0.1.0"
