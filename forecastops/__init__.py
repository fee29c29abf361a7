"""Spark-native operators for transport-style time series."""
