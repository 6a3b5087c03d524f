"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""
