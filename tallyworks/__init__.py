"""Spark-native trend and document analytics."""
