"""Structured Streaming jobs: availableNow ingestion and the gold refresh."""
