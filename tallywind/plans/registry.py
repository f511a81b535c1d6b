"""Table of named queries: each a function of a warehouse, most with an oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywind.plans import oracle
from tallywind.plans.warehouse import Warehouse, open_warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, world: str, sql: str | None = None, prelude: bool = True):
    """Register ``fn(warehouse) -> DataFrame`` under ``key`` for one snapshot world."""

    def wrap(fn: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: fn(open_warehouse(spark, sf_dir, world))
        if sql is not None:
            ORACLES[key] = oracle.sql(world, sql) if prelude else sql
        return fn

    return wrap
