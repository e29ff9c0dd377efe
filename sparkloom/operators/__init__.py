"""Operators on DataFrames and on file datasets."""
