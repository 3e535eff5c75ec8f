"""Spark-native building blocks."""
