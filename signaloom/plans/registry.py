"""All registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .bindings import plain

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("reports", "filtering", "sequences", "joining", "sessions", "procedures", "calls", "media", "flows", "subscribers", "sinks", "streams")
_QUERIES: dict[str, Query] = {}
_CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: ``name`` is the query, ``sql`` what the check engine runs on the same tables."""

    def keep(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(function(spark, sf_dir))

        run.__name__, run.__doc__ = name, function.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _CHECKS[name] = sql
        return function

    return keep


def _load() -> None:
    for module in _MODULES:
        import_module(f"{__package__}.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_CHECKS)
