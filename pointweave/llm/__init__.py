"""Training-data operators: counting, deduplicating, packing, mixing, sharding, scoring and searching corpora."""
