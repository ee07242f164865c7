"""Queries by name, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, and no negative zero: their sums depend on the order of partitions."""
    return df.select(*(((F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c)) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Registers a function of the views, with SQL of the same columns; `doubles` names those that the SQL has yet to round."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Views(spark, sf_dir)))
        if sql is not None:
            replaced = ", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in doubles.split())
            SQL[name] = f"SELECT *{f' REPLACE ({replaced})' if replaced else ''} FROM ({with_views(sql)})"
        return f

    return add
