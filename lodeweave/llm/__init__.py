"""Training-data operators (deduplication, filtering, mixing, sharding, formatting)."""
