"""Spark-native text-corpus retrieval and analytics engine."""
