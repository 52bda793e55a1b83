"""Training-data operators: encoding, near duplicates, scoring, mixing and sharding."""
