"""Spark-native analytics over versioned knowledge graphs and hybrid retrieval."""
