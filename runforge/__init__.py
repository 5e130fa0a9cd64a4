"""Spark jobs over run results and training data."""
