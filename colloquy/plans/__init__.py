"""Registered queries and their DuckDB statements."""
