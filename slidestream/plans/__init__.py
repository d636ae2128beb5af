"""Whole queries, and the pipeline language they can be written in."""
