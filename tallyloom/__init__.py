"""A Spark-native engine for repository, text and event analytics."""
