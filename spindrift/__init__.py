"""Spark-native analytics for trial registry records, and operators for large text corpora."""
