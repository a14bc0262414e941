"""Cell coercions as Column expressions."""
