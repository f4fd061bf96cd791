"""repolith: a PySpark-native engine for code-knowledge analytics."""
