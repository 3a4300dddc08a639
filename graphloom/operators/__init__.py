"""Operators over logical tables: files, symbols, nodes, edges, documents, vectors."""
