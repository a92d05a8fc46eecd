"""Spark-native search and data processing over conversation logs."""
