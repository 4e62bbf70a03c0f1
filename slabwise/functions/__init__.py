"""Column functions: hashes, flags, page arithmetic, Bloom geometry."""
