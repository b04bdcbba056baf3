"""Operators: DataFrames and parameters in, DataFrame out. The present is always a parameter."""
