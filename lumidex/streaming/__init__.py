"""streaming of the document index."""
