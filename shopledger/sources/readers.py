"""Raw layer: lossless strings in, canonical string fields out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import FIELDS, Mapping
from ..functions.spread import row_print
from ..functions.times import local_day, month_of, parse_time
from ..operators.normalize import status
from .records import read_records

# Accepted file encodings and the charset names Spark reads them with.
ENCODINGS = {"utf-8-sig": "UTF-8", "gb18030": "GB18030", "cp1252": "windows-1252"}
SEPARATORS = (",", ";", "\t", "|")


def read_csv(spark: SparkSession, path, columns: Sequence[str], encoding="utf-8-sig", sep=",", multi_line: bool = False) -> DataFrame:
    """CSV with a header as nullable strings; a row of another width fails the read.

    Column pruning is switched off for this read, as a pruned scan does not notice ragged rows. Quoted line breaks need ``multi_line``:
    such files are read in ranges like others, after a pass over their quotes (see records). Without it, encodings other than UTF-8 need
    ``spark.sql.legacy.javaCharsets`` set to true.
    """
    if encoding not in ENCODINGS or sep not in SEPARATORS:
        raise ValueError("unsupported encoding or separator")
    if multi_line:
        return read_records(spark, path, columns, encoding, sep)
    schema = StructType([StructField(name, StringType()) for name in columns])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("encoding", ENCODINGS[encoding])
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("columnPruning", False)
        .csv(path)
    )


def blanks_to_null(df: DataFrame, keep: Sequence[str] = (), seen: Observation | None = None) -> DataFrame:
    """Blank cells become null (others stay untrimmed); rows with no value left are dropped.

    ``seen`` gets the number of rows and of dropped ones from the pass that uses the result, so that nothing is read twice.
    """
    cells = [c for c in df.columns if c not in keep]
    cleaned = df.select(*keep, *[F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c) for c in cells])
    filled = F.coalesce(*[F.col(c) for c in cells]).isNotNull()
    if seen is not None:
        cleaned = cleaned.observe(seen, F.count_if(~filled).alias("blank_rows"), F.count(F.lit(1)).alias("rows"))
    return cleaned.filter(filled)


def counts_seen(spark: SparkSession, seen: Observation) -> DataFrame:
    """One row with the counts of a pass that is done."""
    counts = seen.get
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


def blank_row_count(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    filled = [F.trim(F.col(c)) != "" for c in df.columns if c not in keep]
    any_value = reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in filled])
    return df.agg(F.count_if(~any_value).alias("blank_rows"), F.count(F.lit(1)).alias("rows"))


def union_parts(*parts: DataFrame) -> DataFrame:
    """Append parts of one table; names and order of the headers must be equal."""
    if any(p.columns != parts[0].columns for p in parts[1:]):
        raise ValueError("sheet_schema_mismatch")
    return reduce(DataFrame.unionByName, parts)


def explode_baskets(df: DataFrame, row_id: str, column: str, sep: str = "|") -> DataFrame:
    """One row per listed item: basket_id is the row, source_row_id is ``row:position``."""
    items = F.transform(F.split(F.col(column), "[" + sep + "]"), lambda x: F.trim(x))
    faulty = F.exists(items, lambda x: x == "") | F.col(column).isNull()
    checked = F.when(faulty, F.raise_error(F.lit("empty_basket_item"))).otherwise(items)
    return df.select(F.col(row_id).alias("basket_id"), F.posexplode(checked).alias("pos", "item_id")).select(
        F.concat_ws(":", "basket_id", (F.col("pos") + 1).cast("string")).alias("source_row_id"), "basket_id", "item_id"
    )


def with_row_id(df: DataFrame, keys: Sequence[str], name: str = "source_row_id") -> DataFrame:
    """Stable lineage id built from the caller's key columns."""
    return df.withColumn(name, F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))


def with_content_id(df: DataFrame, name: str = "source_row_id") -> DataFrame:
    """An id for rows without keys: the print of the content and an ordinal among equal rows, which nothing else tells apart."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    each = counted.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    return each.select(*df.columns, F.concat_ws(":", row_print(df.columns), "_copy").alias(name))


def profile(df: DataFrame, examples: int = 3) -> DataFrame:
    """One row per column: rows, missing cells, distinct values and the first few example values.

    The example rank is cut inside each task before the shuffle (window group limit), so a column's
    values never meet in one place.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns]
    values = df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("column").orderBy("value")
    shown = (
        values.filter(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= examples)
        .groupBy("column")
        .agg(F.array_join(F.array_sort(F.collect_list(F.substring("value", 1, 120))), " | ").alias("examples"))
    )
    summary = values.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("distinct_values"),
    )
    return summary.join(shown, "column", "left")


def table_profile(canonical: DataFrame, mapping: Mapping) -> DataFrame:
    """Rows, time span, distinct orders and customers, cancelled and non-positive rows."""
    day = local_day(parse_time(F.col("event_time"), mapping.time_format, mapping.timezone), mapping.timezone)
    number = lambda c: F.col(c).try_cast("double")
    return canonical.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(day).cast("string").alias("first_day"),
        F.max(day).cast("string").alias("last_day"),
        F.count_distinct("order_id").alias("orders"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_if(status(mapping) == "cancelled").alias("cancelled_rows"),
        F.count_if(number("quantity") <= 0).alias("nonpositive_quantity"),
        F.count_if(number("unit_price") <= 0).alias("nonpositive_price"),
    )


def canonicalize(raw: DataFrame, mapping: Mapping, row_id: str = "source_row_id", keep: Sequence[str] = ()) -> DataFrame:
    """Project raw columns on the canonical fields; an unmapped field is null."""
    def value(name):
        if name == "currency" and mapping.currency_constant:
            return F.lit(mapping.currency_constant).alias(name)
        source = mapping.columns.get(name)
        return (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias(name)

    return raw.select(*keep, F.col(row_id).alias("source_row_id"), *[value(name) for name in FIELDS])


def _time_counts(mapping: Mapping) -> list[Column]:
    parsed = parse_time(F.col("event_time"), mapping.time_format, mapping.timezone)
    return [
        F.count("event_time").alias("given"),
        F.count_if(F.col("event_time").isNotNull() & parsed.isNull()).alias("not_conforming"),
    ]


def time_conformance(canonical: DataFrame, mapping: Mapping) -> DataFrame:
    return canonical.agg(*_time_counts(mapping))


def with_counts(rows: DataFrame, mapping: Mapping, seen: Observation) -> DataFrame:
    """The rows as they are; ``seen`` gets rows, given and misfitting times, and raw duplicates from the pass that uses them."""
    twice = F.count_if("duplicate_candidate") if "duplicate_candidate" in rows.columns else F.lit(0).cast("long")
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *_time_counts(mapping), twice.alias("duplicate_candidates"))


def source_calendar(canonical: DataFrame, mapping: Mapping) -> DataFrame:
    """First and last day, months with records, and the month suggested for a report."""
    if mapping.record_kind == "monthly_summary":
        day = F.to_date(F.lit(mapping.summary_month + "-01"))
    else:
        day = local_day(parse_time(F.col("event_time"), mapping.time_format, mapping.timezone), mapping.timezone)
    # Days are distinct before the months are gathered: at most one row per calendar day remains.
    days = canonical.select(day.alias("day")).filter(F.col("day").isNotNull()).distinct()
    span = days.agg(
        F.min("day").alias("start"),
        F.max("day").alias("end"),
        F.array_join(F.array_sort(F.collect_set(month_of(F.col("day")))), ",").alias("months"),
    )
    end = F.last_day("end") if mapping.record_kind == "monthly_summary" else F.col("end")
    partial = (F.last_day("end") != F.col("end")) & (month_of(F.col("start")) != month_of(F.col("end")))
    earlier = F.when(partial, month_of(F.add_months("end", -1))).otherwise(month_of(F.col("end")))
    suggested = month_of(F.col("end")) if mapping.record_kind == "monthly_summary" else earlier
    return span.select(
        F.col("start").cast("string").alias("start"),
        end.cast("string").alias("end"),
        "months",
        suggested.alias("suggested_month"),
    )


def fingerprint(df: DataFrame, by: str = "version_id") -> DataFrame:
    """Row count and order-free content hash per source: exclusive or, and sum, of 60 bits of every row's print."""
    h = F.conv(F.substring(row_print([c for c in df.columns if c != by]), 1, 15), 16, 10).cast("long")
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum(F.pmod(h, F.lit(2147483647))).alias("hash_sum"),
    )


def repeated_sources(prints: DataFrame, by: str = "version_id") -> DataFrame:
    """Sources whose whole content equals that of another one."""
    return (
        prints.groupBy("rows", "hash_xor", "hash_sum")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(by).alias("first_source"), F.max(by).alias("last_source"))
        .filter("copies > 1")
        .select("first_source", "last_source", "copies", "rows")
    )


def keyed_read(df: DataFrame, ids: DataFrame, columns: Sequence[str], key: str = "source_row_id") -> DataFrame:
    """Pruned read of the rows whose id is listed."""
    return df.select(*columns).join(ids.select(key), key, "left_semi")


def weekly_long(wide: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``W0..Wn`` columns to one row per (key, week)."""
    long = wide.unpivot([key], list(columns), "label", "quantity")
    return long.select(key, F.substring("label", 2, 9).cast("int").alias("week"), "quantity")


def preview(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 100) -> DataFrame:
    if not 0 <= offset <= 10_000 or not 1 <= limit <= 100:
        raise ValueError("preview window out of range")
    return df.orderBy(*order).offset(offset).limit(limit)
