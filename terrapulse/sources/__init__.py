"""Readers of landed files and of stored tables."""
