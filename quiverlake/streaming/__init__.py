"""Structured Streaming over the operation log."""
