"""Spark-native analytics for Asset Administration Shell data."""
