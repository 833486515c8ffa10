"""Operators on DataFrames, grouped by subject."""
