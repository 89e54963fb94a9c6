"""Operators for preparing training data: deduplication, filtering, privacy, tokens and search."""
