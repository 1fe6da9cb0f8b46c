"""Operators over fact tables: DataFrames in, a DataFrame out."""
