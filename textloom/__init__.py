"""Text chunking, indexing and retrieval on Spark."""
