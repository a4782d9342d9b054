"""Column functions, ordered aggregates and cryptographic helpers."""
