r"""Line-level deduplication.

Every text is split at ``\n``. A line's key is the line without outer white space (the six ASCII characters), A-Z lower-cased. Keys are
hashed (128 bits), the distinct documents of every hash are counted, and lines whose key has at least ``min_chars`` code points and stands
in at least ``min_documents`` documents are dropped everywhere but in the smallest document that holds them. The other lines stay as
they are, in their positions.

Only hashes and positions are exploded and shuffled: first one row per (hash, document), then one per line. A common line is counted on the map side and
its join may be split at run time. The texts meet their dropped positions once, and a text is put together from the slices between them, so its
work grows with its length alone.

A null or empty text is one empty line. A document is a doc_id: rows that share one count once and are cleaned alike, each returned.
Rows without a doc_id count as one document that comes after all others. Texts that lose all lines become empty. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spread import attach
from .common import dropped, written

#: White space of the contracts.
WHITE = " \t\n\x0b\x0c\r"
HASH, DOCUMENT, ROW = ["_h1", "_h2"], ["_null", "_id"], ["_null", "_id", "_t1", "_t2"]


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(value: Column, names: list[str]) -> list[Column]:
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


def identified(docs: DataFrame) -> DataFrame:
    """doc_id and text with the columns that tell rows apart: id and a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), *hashed(text, ["_t1", "_t2"]))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Row keys, position (from 0) and hash of every line whose key is long enough."""
    rows = identified(docs).select(*ROW, F.posexplode(split_lines(F.col("text"))).alias("position", "_line"))
    rows = rows.withColumn("_key", key(F.col("_line"))).filter(F.length("_key") >= min_chars)
    return rows.select(*ROW, "position", *hashed(F.col("_key"), HASH))


def common_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """Hashes found in at least ``min_documents`` documents, with the number and the smallest of these."""
    per_document = lines.select(*HASH, *DOCUMENT).distinct()
    counted = per_document.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_documents"), F.min(F.struct(*DOCUMENT)).alias("_first"))
    return counted.filter(F.col("n_documents") >= min_documents)


def deduplicated(docs: DataFrame, min_documents: int = 2, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (what stays) of every row."""
    lines = written(long_lines(docs, min_chars), "lines")
    marked = attach(lines, common_lines(lines, min_documents), HASH).filter(F.struct(*DOCUMENT) != F.col("_first"))
    # equal rows name the same positions, so a set of them is no longer than one text
    drops = written(marked.groupBy(*ROW).agg(F.array_sort(F.collect_set("position")).alias("_drops")), "line-drops")
    dropped(lines)
    rows = attach(identified(docs), drops, ROW).withColumn("_lines", split_lines(F.col("text")))
    n_lines = F.size("_lines")
    starts = F.concat(F.array(F.lit(0)), F.transform("_drops", lambda p: p + 1))
    ends = F.concat(F.col("_drops"), F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda start, end: F.slice(F.col("_lines"), start + 1, end - start))
    kept = F.when(F.col("_drops").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    n_dropped = F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops"))
    return rows.select("doc_id", n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), kept.alias("text"))
