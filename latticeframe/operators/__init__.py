"""Operators on arrays, by family."""
