"""Structured Streaming over edits of source files."""
