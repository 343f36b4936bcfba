"""Operators on DataFrames of documents and tokens."""
