"""Spark-first ranked retrieval, retrieval evaluation and mutation replay."""
