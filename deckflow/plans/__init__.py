"""Query catalog (Spark) and the equivalent SQL (DuckDB oracle)."""
