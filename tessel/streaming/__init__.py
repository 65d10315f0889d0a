"""Structured Streaming: online clustering of unbounded rows."""
