"""Schema retrieval: documents, lexical and vector search, fusion and routing."""
