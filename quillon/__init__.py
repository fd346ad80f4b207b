"""A Spark-native engine for generative document retrieval and its training data."""
