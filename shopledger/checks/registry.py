"""Registration of queries with their SQL counterparts, and the shape results are compared in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DecimalType, DoubleType, FloatType, StringType, TimestampNTZType, TimestampType

from .sql import query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Plain result columns: ISO text for dates and times, joined lists, doubles to six places."""
    shown = []
    for field in df.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
            c = F.array_join(c, ",")
        elif isinstance(kind, (DecimalType, DoubleType, FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        shown.append(c.alias(field.name))
    return df.select(*shown)


def check(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name the blocks of checks/sql.py as tables."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = query(sql)
        return build

    return add
