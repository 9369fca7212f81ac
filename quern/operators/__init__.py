"""Relational operators of the dialect, each a DataFrame to a DataFrame."""
