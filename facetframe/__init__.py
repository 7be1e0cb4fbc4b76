"""PySpark-native analytics for planar geometry tables and training-data text."""
