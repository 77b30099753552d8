"""Where queries are registered with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def count() -> Column:
    return F.count(F.lit(1))


def query(*tables: str, sql: str | None = None):
    """Registers a function of the named tables."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put
