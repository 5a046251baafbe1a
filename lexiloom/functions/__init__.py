"""Functions of the text-retrieval engine."""
