"""Spark-first terminology screening engine."""
