"""Structured Streaming forms of the engagement write path."""
