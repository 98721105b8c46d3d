"""Structured Streaming forms of the frame-by-frame operators."""
