"""Column expressions: text, statistics, JSON, hashing and pricing."""
