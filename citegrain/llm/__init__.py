"""Operators that prepare training text: filters, near-duplicates, mixing, sharding, scoring."""
