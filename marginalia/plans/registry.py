"""All queries of the library and their SQL."""

from __future__ import annotations

from . import concept_queries, graph_queries, information_queries, relation_queries, statistic_queries, table_queries, window_queries  # noqa: F401  (each module registers its queries)
from .base import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
