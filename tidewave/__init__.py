"""Spark-native acoustic-sensing analytics."""
