"""Spark-native document-compliance analytics."""
