"""Corpus preparation, passage chunking and retrieval evaluation on Spark."""
