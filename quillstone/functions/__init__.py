"""Column functions: text analysis, vectors, hashing."""
