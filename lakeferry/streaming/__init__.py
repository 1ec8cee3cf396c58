"""Loads driven by Structured Streaming; an extension of our own."""
