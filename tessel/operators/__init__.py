"""Operators on DataFrames whose key, text and edge columns are parameters."""
