"""Bindings of the shared test tables, and the queries checked against DuckDB."""
