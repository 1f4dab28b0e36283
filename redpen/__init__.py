"""Spark-native corpus processing and correction scoring."""
