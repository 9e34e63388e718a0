"""Names of the queries, and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; `sql` gives the same rows with the same column names."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from . import analytics_queries, crawl_queries, index_queries, search_queries, stream_queries, table_queries, text_queries  # noqa: E402, F401
