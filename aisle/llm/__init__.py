"""Operators for training-data pipelines over documents, embeddings and recordings.

Nothing else in the library imports this package. Its queries and SQL are in
``registry``.
"""
