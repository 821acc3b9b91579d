"""Structured Streaming forms of the continuous steps."""
