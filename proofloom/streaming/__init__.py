"""Streaming twins of the log operators."""
