"""Training-data operators: deduplication, filtering, sharding, tokenising, mixing and language ID."""
