"""millrace: a PySpark-native analytics engine."""
