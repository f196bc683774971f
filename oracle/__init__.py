"""SQL twins of the queries, written from the rules for DuckDB."""
