"""Training-data operators: extraction, filters, deduplication, tokenizing, scoring.

Nothing else in the library imports this subpackage.
"""
