"""Spark-first structural-context sequence analytics."""
