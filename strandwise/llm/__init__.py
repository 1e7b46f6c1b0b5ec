"""Training-data operators over documents, embeddings and pages; nothing else in the library imports this package."""
