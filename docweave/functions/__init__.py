"""Column expressions on values, pairs and document maps."""
