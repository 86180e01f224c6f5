"""Registered queries: each applies an operator to views over the given tables, with its DuckDB equivalent."""
