"""Structured Streaming forms of intake and timing."""
