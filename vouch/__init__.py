"""Spark-native screening and record-verification analytics."""
