"""Operators of record linkage on DataFrames."""
