"""Readers of raw session logs and their normalisation to the library's tables."""
