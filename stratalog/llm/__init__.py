"""Operators for large training-data corpora.

Nothing outside this subpackage imports it.  ``stratalog.llm.queries`` holds the
registered queries and their SQL.
"""
