"""Structured Streaming forms of the weekly counts, sessions and rankings."""
