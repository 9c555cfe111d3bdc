"""Spark-native narrative text analytics."""
