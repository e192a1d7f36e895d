"""sources of the document index."""
