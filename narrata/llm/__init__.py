"""Training-data operators: dedup, filtering, mixing, sharding, extraction and output."""
