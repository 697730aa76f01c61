"""Column expressions and the caller-supplied text functions."""
