"""Operators for preparing training text: deduplication, filtering, archives, scoring, mixing."""
