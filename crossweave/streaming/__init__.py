"""Incremental updates of panels with Structured Streaming."""
