"""A PySpark-native engine for evidence and document analytics."""
