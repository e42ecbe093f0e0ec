"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers them over the driver's tables.
"""
