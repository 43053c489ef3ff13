"""Spark-native live-query and analytics engine."""
