"""Column expressions and element types."""
