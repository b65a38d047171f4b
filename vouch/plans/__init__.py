"""Queries over the given tables, and the tables they are derived from."""
