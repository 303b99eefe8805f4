"""Operators of a training-data pipeline over `documents` and `embeddings`.

Nothing outside this package imports it. Each operator module holds the
operator with a general interface; `queries` holds the thin registered
queries and their SQL.
"""
