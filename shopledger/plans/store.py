"""A store of sales sources that grows file by file: rows by month and source, daily facts by month.

A source that arrives late, or again with other content, changes only months inside its range of days (the old and the new one): there its rows may be copies of
others, and it replaces what earlier sources say. Those months are rebuilt from their partitions, together with rows of other months that belong to
the same orders; all other files stay as they are. A ledger of sources holds each one's range and months.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..config import Mapping, Report
from ..operators.sales import daily_fact, label
from ..sources.stage import staged

#: The month of rows without a day.
NO_MONTH = "unknown"
LEDGER = "version_id string, source_no int, start date, end date, months array<string>, number long"


def month(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(NO_MONTH))


def months_between(start: date | None, end: date | None) -> set[str]:
    out, at = set(), start
    while at is not None and at <= end:
        out.add(f"{at:%Y-%m}")
        at = date(at.year + at.month // 12, at.month % 12 + 1, 1)
    return out


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """The latest entry of every source."""
    try:
        entries = spark.read.schema(LEDGER).parquet(f"{folder}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)
    latest = entries.groupBy("version_id").agg(F.max_by(F.struct("source_no", "start", "end", "months", "number"), "number").alias("_e"))
    return latest.select("version_id", "_e.*")


def stored_rows(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All rows, with month and source."""
    return spark.read.schema(StructType([*schema.fields, StructField("month", StringType()), StructField("source", IntegerType())])).parquet(f"{folder}/rows")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """The daily facts of all months."""
    return spark.read.parquet(f"{folder}/daily").drop("month")


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def put(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def add_source(folder: str, rows: DataFrame, mapping: Mapping, report: Report) -> list[str]:
    """Store one source's normalised rows (version_id, source_no) in place of what it held before; returns the months rebuilt."""
    spark, schema = rows.sparkSession, rows.schema
    placed = staged(rows.withColumns({"month": month(F.col("day")), "source": F.col("source_no").cast("int")}), "incoming")
    facts = placed.groupBy("version_id", "source").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.sort_array(F.collect_set("month")).alias("months")).collect()
    if len(facts) != 1:
        raise ValueError("one source at a time")
    new, known = facts[0], {r.version_id: r for r in sources(spark, folder).collect()}  # a row per source
    old = known.get(new.version_id)
    if any(r.source_no == new.source and r.version_id != new.version_id for r in known.values()):
        raise ValueError("source numbers are taken once")
    touched = months_between(new.start, new.end) | set(new.months)
    if old is not None:
        touched |= months_between(old.start, old.end) | set(old.months)
        for gone in set(old.months) - (set(new.months) if old.source_no == new.source else set()):
            removed(spark, f"{folder}/rows/month={gone}/source={old.source_no}")
    put(placed, f"{folder}/rows", "month", "source")
    number = 1 + max((r.number for r in known.values()), default=0)
    entry = (new.version_id, new.source, new.start, new.end, new.months, number)
    spark.createDataFrame([entry], LEDGER).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
    rebuild(spark, folder, schema, mapping, report, sorted(touched))
    return sorted(touched)


def rebuild(spark: SparkSession, folder: str, schema: StructType, mapping: Mapping, report: Report, touched: list[str]) -> None:
    """Daily facts of the touched months, from their rows and from the rest of the orders that reach into them."""
    rows = stored_rows(spark, folder, schema)
    inside = F.col("month").isin(touched)
    here = rows.filter(inside)
    reaching = here.filter(F.col("order_id").isNotNull()).select("version_id", "order_id").distinct()
    rest = rows.filter(~inside).join(reaching, ["version_id", "order_id"], "left_semi")
    ranges = sources(spark, folder).filter(F.col("start").isNotNull()).select("version_id", "source_no", "start", "end")
    labelled = label(here.unionByName(rest).select(*schema.fieldNames()), mapping, report, ranges)
    facts = daily_fact(labelled, mapping).withColumn("month", month(F.col("day"))).filter(inside)
    facts = staged(facts, "daily")
    put(facts, f"{folder}/daily", "month")
    filled = {r.month for r in facts.select("month").distinct().collect()}  # at most the touched months
    for empty in set(touched) - filled:
        removed(spark, f"{folder}/daily/month={empty}")
