"""Column functions: text, hashing, vectors, scalars."""
