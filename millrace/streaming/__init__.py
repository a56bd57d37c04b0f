"""Structured Streaming forms of the hourly metrics."""
