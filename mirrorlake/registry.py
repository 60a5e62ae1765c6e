"""All registered queries of the engine's own operators, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; a name is registered once."""

    def put(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if oracle is not None:
            _ORACLES[name] = oracle
        return query

    return put


def queries() -> dict[str, Query]:
    from . import plans  # noqa: F401  the modules register their queries when first imported

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _ORACLES
