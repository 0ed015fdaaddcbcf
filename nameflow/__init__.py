"""Spark-native analytics of DNS traffic captures."""
