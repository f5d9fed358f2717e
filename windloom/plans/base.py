"""How a query is registered: a function of (spark, data folder), and SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and integers as BIGINT, as the SQL gives them."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.dtypes))
