"""Numeric claim verification and training-data operators as Spark jobs."""
