"""Operators for preparing training text, each a function of DataFrames."""
