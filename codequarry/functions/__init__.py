"""Column functions: text, code and paths."""
