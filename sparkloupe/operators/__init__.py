"""Operators, DataFrame in and DataFrame out."""
