"""Column functions: keys, numbers, JSON, vectors, scores, geometry, digests."""
