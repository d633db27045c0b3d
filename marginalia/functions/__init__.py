"""Column functions: text, arrays."""
