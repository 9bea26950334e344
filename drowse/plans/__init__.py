"""Queries over the given tables, and longer workloads."""
