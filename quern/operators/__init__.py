"""Relational, vector and text operators over DataFrames."""
