"""Quarry: a PySpark-native analytics and retrieval engine for conversation archives."""
