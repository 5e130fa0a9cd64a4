"""Joins, aggregations, windows and samples over runs and training rows."""
