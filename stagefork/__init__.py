"""Spark-native analytics for multi-stage retrieval, with worlds as rows."""
