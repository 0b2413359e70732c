"""Column functions: paths, text, keys."""
