"""Structured Streaming forms of operators that grow with arriving data."""
