"""Column expressions: text, hashing and statistics."""
