"""Structured Streaming forms of the windowed queries."""
