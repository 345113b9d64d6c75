"""Column functions: text, chunking, identity, vectors, filters, embedding."""
