"""Structured Streaming forms of ingest, completeness and metric status."""
