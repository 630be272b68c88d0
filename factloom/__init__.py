"""Spark-native engine for building and maintaining question-and-answer knowledge bases."""
