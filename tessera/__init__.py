"""Spark-native document processing, retrieval, answering and evaluation."""
