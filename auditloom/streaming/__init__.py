"""Structured Streaming forms of the event-count and disorder metrics."""
