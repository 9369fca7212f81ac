"""Syntax tree to typed statement to DataFrame."""
