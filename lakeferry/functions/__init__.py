"""Column-level functions: logical types, casts, paths and URLs."""
