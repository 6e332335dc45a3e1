"""Table-level operators: every function maps DataFrames to DataFrames and stays lazy."""
