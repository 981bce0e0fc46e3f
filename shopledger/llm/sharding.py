"""Sharding by proportional stratified interleaving; law ``rows``.

Rows of a source are ranked in a seeded random order; rank r of n gets the fraction (r - 0.5) / n. Sorted by that
fraction all sources run through the order evenly, so any cut of it holds the sources in their proportion, to within
one row per source. Cutting into equal numbers of rows gives shards whose counts differ by at most one.

Equal texts have no place of their own in this law: they are spread like any rows. Null source: one source, last. Null text:
size 16, checksum of the empty text. Repeated rows are placed one by one. Fewer rows than shards leave shards empty; an empty table
gives no rows. ``placed`` reads only the columns it names, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, source_key, unit

SEED = 7


def placed(rows: DataFrame, shards: int, orders: list[str], seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; ``orders`` (a unique key, without clashing names) makes the shuffle's order total."""
    keyed = rows.select("*", *source_key(F.col("source")), unit(*orders, seed=seed).alias("_draw"))
    inside = ranked(keyed, ["_null", "_source"], ["_draw", *orders], "shards-sources")
    spread = inside.withColumn("_at", (2 * F.col("_rank") - 1) / (2 * F.col("_n"))).drop("_rank", "_n", "_draw")
    line = ranked(spread, [], ["_at", "_null", "_source", *orders], "shards-order")
    at, n, k = F.col("_rank") - 1, F.col("_n"), F.lit(shards)
    shard = F.expr(f"((_rank - 1) * {shards}) div _n").cast("int")
    first = F.expr(f"(shard * _n + {shards - 1}) div {shards}")
    return line.withColumn("shard", shard).withColumn("slot", (at - first).cast("long")).drop("_null", "_source", "_at", "_rank", "_n")


def sharded(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """Place of every document: doc_id, source, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = placed(rows, shards, ["doc_id", "size", "text_crc32"], seed)
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


#: What tells a document's place apart: id, source, size and checksum. Rows that agree in all of them are interchangeable.
MATCH = ["__null", "__id", "__nosource", "__source", "__size", "__crc"]


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with a number among those that agree in MATCH, so that repeated rows find a place each."""
    return ranked(rows, MATCH, order, label).withColumnRenamed("_rank", "__copy").drop("_n")


def matching(doc_id: Column, source: Column, size: Column, crc: Column) -> list[Column]:
    values = doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), source.isNull(), F.coalesce(source, F.lit("")), size, crc
    return [v.alias(name) for v, name in zip(values, MATCH, strict=True)]


def write(docs: DataFrame, places: DataFrame, folder: str) -> None:
    """Store the documents below ``folder`` by shard, each shard's files in slot order; ``places`` come from ``sharded``.

    Rows are matched one to one, null and repeated ids included. A large shard is several files, by ranges of its slots.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = matching(F.col("doc_id"), F.col("source"), (F.octet_length(text) + 16).cast("long"), F.crc32(text.cast("binary")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *own, F.monotonically_increasing_id().alias("__n"))
    there = places.select("shard", "slot", *matching(*[F.col(c) for c in ("doc_id", "source", "size", "text_crc32")]))
    met = numbered(rows, ["__n"], "shards-rows").join(numbered(there, ["shard", "slot"], "shards-places").hint("merge"), [*MATCH, "__copy"])
    whole = met.select(F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), "__row").repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    whole.select("__row.*", F.col("__slot").alias("slot"), F.col("__shard").alias("shard")).write.partitionBy("shard").parquet(folder)
