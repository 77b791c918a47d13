"""Structured Streaming forms of the fact operators."""
