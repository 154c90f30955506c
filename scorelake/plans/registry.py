"""Named queries and the SQL each must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.plans.fixtures import Tables, with_views

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_FAMILIES = ("functions", "readings", "scoring", "reports", "cases", "corpus", "graph", "io", "live")


def query(name: str, sql: str | None = None, longs: tuple[str, ...] = ()):
    """Register `fn(tables) -> DataFrame`; `sql` is omitted where no SQL can express it.

    `longs` names integer columns that the oracle returns as BIGINT.
    """
    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = lambda t: fn(t).withColumns({c: F.col(c).cast("bigint") for c in longs}) if longs else fn(t)
        if sql is not None:
            _ORACLES[name] = with_views(sql)
        return fn
    return register


def _load() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"scorelake.plans.q_{family}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
