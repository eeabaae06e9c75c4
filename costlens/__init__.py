"""Spark-native analytics for multi-cloud billing data."""
