"""Query registry: one Spark query per inventory key plus its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    sql: str | None
    digits: int = 6


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    Output columns are normalised by :func:`finalize`: integers as BIGINT,
    floats rounded to ``digits`` (the oracle SQL rounds the same way).
    """
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir), digits)
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(wrapped, sql, digits)
        return wrapped
    return deco


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)
