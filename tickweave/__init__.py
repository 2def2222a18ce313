"""Spark-native operators for intraday signal research and corpus preparation."""
