"""Training-data operators: deduplication, sharding, archives, scoring, packing, tokenization."""
