"""Spark-native analytics over streams of payment-style events."""
