"""Spark-native analytics for card payments: behaviour features, fraud reports, drift and model checks."""
