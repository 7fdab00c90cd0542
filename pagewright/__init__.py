"""Spark-native engine for archives of dated free text."""
