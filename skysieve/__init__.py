"""Spark-native catalogue matching and corpus preparation."""
