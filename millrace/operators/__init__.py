"""Analytic operators: DataFrames to DataFrames, with time passed in and nothing mutated."""
