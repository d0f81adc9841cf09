"""Structured Streaming forms of the ingest plan."""
