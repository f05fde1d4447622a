"""Spark-native analytics for noisy search queries and large text collections."""
