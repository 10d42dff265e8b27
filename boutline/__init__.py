"""boutline: a PySpark-native engine for bout-style event analytics."""
