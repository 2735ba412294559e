"""Ingestion on Structured Streaming."""
