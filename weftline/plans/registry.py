"""All queries over the driver's tables, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("graph_queries", "log_queries", "more_queries", "coverage_queries", "rest_queries")


def query(oracle: str | None = None):
    """Decorator: registers a query under its function name, with its DuckDB SQL."""

    def add(f):
        if f.__name__ in _QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def _load() -> None:
    import importlib

    for name in _MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
