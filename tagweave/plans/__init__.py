"""Query catalog (Spark) and oracle SQL (DuckDB)."""
