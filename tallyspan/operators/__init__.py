"""Operators over the domain tables: DataFrames in, DataFrames out."""
