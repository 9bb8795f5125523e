"""Structured Streaming forms of capture, rates and chaining."""
