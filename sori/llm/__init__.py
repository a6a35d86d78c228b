"""Training-data operators: packing, toxicity, deduplication, archives, search, tokens, sharding."""
