"""Incremental publishing with Structured Streaming."""
