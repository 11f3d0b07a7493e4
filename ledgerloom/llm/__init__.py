"""Operators for large-scale training-data pipelines over a ``documents`` table."""
