"""Spark-native analytics over point-in-time panels."""
