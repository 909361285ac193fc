"""Structured Streaming forms of presence, sessions and colour teams."""
