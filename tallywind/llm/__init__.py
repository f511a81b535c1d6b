"""Operators over text corpora, vectors, pages and conversations. Nothing outside imports this."""
