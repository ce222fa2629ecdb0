"""Structured Streaming forms of the live aggregation."""
