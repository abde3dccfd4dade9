"""Registry of driver-table bindings.

Each binding is a callable ``(spark, sf_dir) -> DataFrame`` plus, where the
semantics are expressible in plain SQL, the equivalent DuckDB query over the
same Parquet tables (the correctness oracle). Column names are aliased
identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a binding under ``name`` with optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql.strip()
        return fn
    return deco


def _load_all() -> None:
    # Import for side effects (registration). Order fixes the listing order.
    from tessera.plans import (  # noqa: F401
        track_b, dates, corpus, profile, ddl, datagen, responses, evaluate,
        sqlcases, sinks, stream,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
