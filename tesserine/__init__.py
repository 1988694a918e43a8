"""Spark-native engine for hypervector memory, text retrieval and graph expansion."""
