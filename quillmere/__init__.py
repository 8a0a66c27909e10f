"""A Spark-native engine for document collections: text, retrieval, evaluation, operations."""
