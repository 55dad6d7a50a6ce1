"""Spark-native memory and retrieval analytics engine."""
