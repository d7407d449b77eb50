"""Structured Streaming variants of the row-local techniques."""
