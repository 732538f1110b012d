"""Structured Streaming: ingestion of mutation streams."""
