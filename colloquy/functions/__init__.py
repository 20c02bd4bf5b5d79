"""Column functions: text primitives."""
