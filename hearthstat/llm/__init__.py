"""Operators for preparing training text: packing, scoring, archives, filters and duplicates."""
