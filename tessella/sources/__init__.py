"""Readers and writers of vault files and record tables."""
