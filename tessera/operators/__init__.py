"""Operators on collections as DataFrames."""
