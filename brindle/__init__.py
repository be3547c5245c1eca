"""Spark-native engine for partitioned, keyed batch data."""
