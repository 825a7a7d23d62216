"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this subpackage imports it; ``tidemark.llm.queries`` holds its registered queries.
"""
