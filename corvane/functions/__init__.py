"""Column functions: text, hashes, JSON and visibility."""
