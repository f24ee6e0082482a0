"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)``; ``covers`` lists the inventory entries it exercises."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query '{name}' is registered twice.")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if check is not None:
            CHECKS[name] = check
        return fn

    return register
