"""Structured Streaming forms of the join."""
