"""Column functions: text, numbers and similarity."""
