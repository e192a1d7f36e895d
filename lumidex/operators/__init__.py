"""operators of the document index."""
