"""Incremental re-indexing on Structured Streaming."""
