"""Spark-native analytics over ordered event data."""
