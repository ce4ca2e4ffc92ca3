"""Spark-native inspection and sanitization of large text collections."""
