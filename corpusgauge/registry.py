"""Name -> (Spark callable, DuckDB statement) for every registered query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql=None`` means it has no closed SQL form."""

    def register(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, fn, sql)
        return fn

    return register


def all_queries() -> dict[str, Query]:
    # Importing the binding modules fills the registry.
    from corpusgauge import queries

    queries.load_all()
    return dict(_QUERIES)
