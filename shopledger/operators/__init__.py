"""User-level operators, DataFrames in and a DataFrame out."""
