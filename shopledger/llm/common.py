"""Helpers shared by the operators: stored tables, ranks without one-task sorts, cached word encoding."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stage import is_local

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it.

    Batches to the workers are kept small (rows and bytes), as texts can be long and a worker holds a batch several times over.
    """
    if getattr(spark.sparkContext, "_shopledger_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / "shopledger.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._shopledger_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local folder on a local master only."""
    stated = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if stated:
        return stated.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'shopledger-llm')}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` in the shared folder and continue from the files; lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, once nothing lazy needs them any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def unit(*keys: Column | str, seed: int = 0) -> Column:
    """A uniform number in [0, 1) decided by the keys and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def running(rows: DataFrame, groups: Sequence[str], slot: str, n: str, out: str) -> DataFrame:
    """Per (groups, slot) count ``n``, plus ``out``: the sum of ``n`` over the group's smaller slots."""
    before = Window.partitionBy(*groups).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(n).over(before), F.lit(0)))


class WordTable(dict):
    """What ``encode`` gives for a word, computed on first use; one per worker, of bounded size.

    Words longer than ``longest`` are encoded on each use, so that odd inputs cannot fill the memory; at ``limit``
    entries it starts afresh.
    """

    def __init__(self, encode: Callable, limit: int = 200_000, longest: int = 48):
        super().__init__()
        self.encode, self.limit, self.longest = encode, limit, longest

    def __missing__(self, word):
        value = self.encode(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def source_key(source: Column) -> tuple[Column, Column]:
    """Two columns without nulls that sort like the source by code point, null last."""
    return source.isNull().alias("_null"), F.coalesce(source, F.lit("")).alias("_source")


def ranked(rows: DataFrame, groups: Sequence[str], orders: Sequence[str], label: str) -> DataFrame:
    """``rows`` with ``_rank`` (from 1) in their group by ``orders`` and the group's ``_n``; no group sits in one task.

    Rows are dealt by ranges of (groups, orders) and stored, each range is ranked by itself, and the counts per
    (range, group) give the offsets. ``groups`` must hold no nulls; ``orders`` should decide all but equal rows.
    """
    placed = written(rows.repartitionByRange(*groups, *orders).withColumn("_part", F.spark_partition_id()), label)
    counts = placed.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_c"))
    # one row per range and group that it meets
    per = Window.partitionBy(*(groups or [F.lit(0)]))
    before = per.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *groups, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(per).alias("_n"))
    inside = Window.partitionBy("_part", *groups).orderBy(*orders)
    joined = placed.withColumn("_r", F.row_number().over(inside)).join(offsets, ["_part", *groups])
    return joined.withColumn("_rank", F.col("_r") + F.col("_before")).drop("_r", "_before", "_part")
