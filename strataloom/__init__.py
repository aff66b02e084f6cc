"""strataloom: a Spark-native engine for document collections and bibliographic catalogues."""

__version__ = "0.1.0"
