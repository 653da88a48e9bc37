"""SQL twins of the analyses, written for DuckDB over the driver's tables."""
