"""Joins, aggregates, sorting and changes, as DataFrame operations."""
