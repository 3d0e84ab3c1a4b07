"""Named queries with their DuckDB equivalents."""
