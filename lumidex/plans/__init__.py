"""plans of the document index."""
