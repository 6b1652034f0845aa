"""Spark-native analytics over source findings, call graphs and error events."""
