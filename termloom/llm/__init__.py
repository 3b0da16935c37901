"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; :mod:`termloom.llm.queries` derives the registered queries.
"""
