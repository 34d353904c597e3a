"""Spark-native analytics for environmental sensor networks."""
