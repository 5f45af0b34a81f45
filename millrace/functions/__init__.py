"""Column functions on keys and records."""
