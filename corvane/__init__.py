"""Spark-native analytics for signals, similarity search and ranked evaluation."""
