"""Operators for preparing training text: deduplication, filtering, scoring, packing, search."""
