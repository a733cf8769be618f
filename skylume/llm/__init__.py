"""Operators for large training-text pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``queries`` registers the thin digest queries.
"""
