"""Structured Streaming: the merge queue."""
