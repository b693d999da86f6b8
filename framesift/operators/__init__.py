"""Operators: DataFrames and parameters in, a DataFrame out; every order has an explicit tie-break."""
