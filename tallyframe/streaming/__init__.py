"""Structured Streaming over result rows."""
