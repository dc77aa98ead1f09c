"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it: the rest of the library works with
the folder removed.  Each module holds one operator and the ``opN_<name>``
query that applies it to a whole table; ``registry`` gathers the queries.
"""
