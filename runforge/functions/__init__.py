"""Column functions and a few vectorized helpers."""
