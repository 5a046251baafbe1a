"""Sources of the text-retrieval engine."""
