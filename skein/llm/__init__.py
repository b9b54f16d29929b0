"""Training-data operators: near-dedup, scoring, privacy, packing, encoding and sharding."""
