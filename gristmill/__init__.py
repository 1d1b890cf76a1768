"""Spark-first text matching, rule scoring and graph analytics."""
