"""Corvane: a Spark-native engine for code facts, retrieval, history and graph analytics."""
