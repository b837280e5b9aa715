"""Every operator as a query over the given tables, with an SQL counterpart where one exists."""

from newsweft.catalog import source_queries as _first  # noqa: F401 (views other modules use)
from newsweft.catalog import briefing_queries, graph_queries, model_queries, select_queries, source_queries, store_queries, text_queries  # noqa: F401
from newsweft.catalog.core import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
