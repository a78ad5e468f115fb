"""Incremental variants for Structured Streaming."""
