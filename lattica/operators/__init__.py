"""Operators over the code graph, DataFrame to DataFrame."""
