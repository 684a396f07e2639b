"""Operators for preparing training text: filters, near-duplicates, tagging, encoding and packing."""
