"""Spark-first analytics over research literature and document corpora."""
