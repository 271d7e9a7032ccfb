"""Structured Streaming forms of the log-record operators."""
