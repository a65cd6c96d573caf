"""Spark-native equity factor risk."""
