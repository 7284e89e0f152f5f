"""Structured Streaming forms of the filters."""
