"""Operators on transactions, graphs and scores: each a function from DataFrames to DataFrames."""
