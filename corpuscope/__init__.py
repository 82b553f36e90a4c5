"""Corpus analytics over public comments as Spark DataFrame operators."""
