"""Spark-native rule scanning and corpus preparation."""
