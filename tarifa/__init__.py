"""Spark-native product matching and price comparison."""
