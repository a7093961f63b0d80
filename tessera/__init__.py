"""Spark-first analytics for sequence-attribution data."""
