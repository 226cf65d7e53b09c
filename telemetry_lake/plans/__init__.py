"""The registered query catalogue (Spark) and its DuckDB oracle SQL."""
