"""Readers of raw files and collections."""
