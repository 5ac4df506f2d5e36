"""Spark-native analytics for objects that move through time."""
