"""End-to-end jobs (train / detect / capture / convert), sinks, and the
registered query catalog with its DuckDB oracle SQL."""
