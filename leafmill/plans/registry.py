"""All registered queries of the document engine, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``f`` under ``name``, with SQL that gives the same rows where SQL can."""

    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLE[name] = oracle
        return f

    return register


def _load() -> None:
    from leafmill.plans import answers, changing, extras, incoming, reading, records, streams  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLE
