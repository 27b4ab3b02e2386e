"""Column functions: coercions and text."""
