"""Scalar and aggregate functions with DuckDB's semantics."""
