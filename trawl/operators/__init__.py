"""Relational operators: chunking, indexing, search, scoring, retrieval."""
