"""Structured Streaming over feeds of file changes."""
