"""Structured Streaming forms of the chunked steps."""
