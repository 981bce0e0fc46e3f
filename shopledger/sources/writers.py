"""Sinks: zstd Parquet, spreadsheet-safe CSV, JSON reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).option("compression", "zstd").parquet(path)


def formula_guard(c: Column) -> Column:
    """A leading quote keeps a spreadsheet from reading text as a formula."""
    return F.when(F.ltrim(c).rlike("^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)


def guard_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: formula_guard(F.col(c)) for c in columns})


def write_csv_safe(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    guard_columns(df, columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """One JSON document per row, next to its key."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("document"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
