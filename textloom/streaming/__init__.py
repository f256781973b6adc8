"""Streams of file changes."""
