"""Spark-native analytics for document archives."""
