"""Operators for large-scale training-data pipelines.

Nothing else in ``tesserine`` imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` holds the thin benchmark
queries that derive digest columns from them.
"""
