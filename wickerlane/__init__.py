"""wickerlane: a PySpark-native engine for retail transaction analytics and ranking."""

__version__ = "0.1.0"
