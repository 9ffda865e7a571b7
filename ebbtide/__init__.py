"""Spark-native analytics for ridge heads learned over an ordered sequence of domains."""
