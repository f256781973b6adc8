"""Column functions and plain text functions."""
