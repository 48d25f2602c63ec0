"""Operators for large training-text corpora.

Ten operators, one module each, and the query catalogue that binds them to
the tables ``documents``, ``pages`` and ``embeddings``.  Nothing else in
the library imports this subpackage.
"""
