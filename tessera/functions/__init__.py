"""Column functions: text, vectors, identity, payloads."""
