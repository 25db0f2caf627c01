"""A Spark-native engine for document retrieval and study material."""
