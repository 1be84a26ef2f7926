"""Operators over DataFrames, by subject."""
