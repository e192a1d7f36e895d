"""functions of the document index."""
