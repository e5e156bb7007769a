"""Operators that prepare training text: filtering, extraction, search, scoring, deduplication and packing."""
