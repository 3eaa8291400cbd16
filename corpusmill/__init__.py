"""Corpus analytics as PySpark DataFrame operators."""
