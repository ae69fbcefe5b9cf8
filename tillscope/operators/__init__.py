"""Operators: lazy functions from a Star (and filters) to a DataFrame."""
