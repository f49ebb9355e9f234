"""Operators for building training data from corpora of documents, pages and chats.

Nothing else in the library imports this subpackage. Every operator takes DataFrames,
keeps extra columns out of its work, and returns a DataFrame; ``queries`` applies each
of them to its whole test table.
"""
