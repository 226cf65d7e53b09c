"""Landing-zone NDJSON, published tables and knowledge sources."""
