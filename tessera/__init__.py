"""Spark-native text tokenization, decoding analytics and file-set checks."""
