"""A PySpark-native engine for spatial tissue analytics."""
