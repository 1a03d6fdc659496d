"""Spark-native corpus, retrieval and evaluation operators for grounded report collections."""
