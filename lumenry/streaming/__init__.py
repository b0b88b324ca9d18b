"""Streaming forms of the append loop."""
