"""Spark-native text retrieval and analytics."""
