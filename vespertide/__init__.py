"""A Spark-native engine for item retrieval, ranking and corpus preparation."""
