"""Spark-native news intelligence: DataFrame and Structured Streaming operators."""
