"""Structured Streaming forms of ingest, series and de-duplication."""
