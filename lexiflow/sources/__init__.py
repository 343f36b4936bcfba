"""Readers of text corpora."""
