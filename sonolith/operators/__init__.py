"""Relational and signal operators over DataFrames."""
