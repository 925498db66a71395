"""Retrieval, recommendation and usage analytics as declarative Spark plans."""
