"""Streaming forms of interval operators."""
