"""Spark-native epoch analytics: signals to features, honest evaluation, drift and retrieval."""

__version__ = "0.1.0"
