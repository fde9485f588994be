"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own interface; :mod:`loamtext.llm.queries` holds the registered queries.
"""
