"""Structured Streaming forms of the incremental event load."""
