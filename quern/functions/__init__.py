"""Column functions (built-in expressions wherever they exist)."""
