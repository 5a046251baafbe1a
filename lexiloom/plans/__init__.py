"""Plans of the text-retrieval engine."""
