"""Spark-native analytics over multilingual support conversations."""
