"""Column expressions: guarded arithmetic and window statistics."""
