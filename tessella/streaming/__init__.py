"""Structured Streaming variants of the append-only journals."""
