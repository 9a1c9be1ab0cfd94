"""Corpus construction and evidence retrieval as Spark DataFrame, SQL and streaming operators."""
