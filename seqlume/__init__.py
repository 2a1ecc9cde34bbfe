"""Spark-native sequence and variant analytics."""
