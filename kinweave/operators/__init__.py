"""Relational operators of record linkage, DataFrame to DataFrame."""
