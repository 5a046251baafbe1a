"""Operators of the text-retrieval engine."""
