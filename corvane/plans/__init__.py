"""The query language: parse, rewrite, lower to DataFrames, estimate."""
