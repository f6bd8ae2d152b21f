"""Name -> query and SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Register a query; without SQL, where that would take too long, tests hold its result."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(name: str, digits: int = 6, alias: str | None = None) -> Column:
    return F.round(F.col(name), digits).alias(alias or name)


def model_columns(model: DataFrame, digits: int = 6) -> DataFrame:
    """A 2-D model table with scalar, rounded columns."""
    cov = [F.get(F.get("cov", i), j) for i, j in ((0, 0), (0, 1), (1, 1))]
    return model.select(
        "component",
        rounded("weight", digits),
        F.round(F.get("mean", 0), digits).alias("mean_x"),
        F.round(F.get("mean", 1), digits).alias("mean_y"),
        F.round(cov[0], digits).alias("cov_xx"),
        F.round(cov[1], digits).alias("cov_xy"),
        F.round(cov[2], digits).alias("cov_yy"),
    )
