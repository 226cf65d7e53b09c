"""Reusable column expressions and SQL table functions."""
