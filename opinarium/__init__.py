"""A Spark-native engine for comment analytics."""
