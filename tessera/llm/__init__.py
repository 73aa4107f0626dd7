"""Operators that prepare training data: dedup, language, mixing, sharding, packing, token files."""
