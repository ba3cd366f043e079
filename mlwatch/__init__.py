"""Spark-native analytics for watching machine-learning data and models."""
