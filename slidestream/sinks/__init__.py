"""Outputs: CSV with six decimals, console, functions over rows."""
