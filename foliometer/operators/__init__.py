"""Operators: DataFrames and plain parameters in, one DataFrame out."""
