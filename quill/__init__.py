"""Spark-first policy and behaviour analytics."""
