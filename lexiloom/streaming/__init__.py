"""Streaming of the text-retrieval engine."""
