"""Queries over the driver tables, one module for each kind of operator, with SQL for DuckDB."""
