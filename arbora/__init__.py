"""Spark-native analytics for branching-tree morphology and connectivity tables."""
