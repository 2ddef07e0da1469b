"""Incremental labelling with Structured Streaming."""
