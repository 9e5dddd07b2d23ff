"""A PySpark-native analytics engine for large text corpora."""

__version__ = "0.1.0"
