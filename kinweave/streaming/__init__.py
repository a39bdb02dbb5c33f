"""Incremental linkage on Structured Streaming."""
