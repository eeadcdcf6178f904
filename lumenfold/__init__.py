"""Spark-native analytics over dated text entries."""
