"""Column functions: text cascades and domain scalars, all built from native expressions."""
