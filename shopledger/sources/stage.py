"""Intermediate tables: written once to the shared checkpoint folder, read by every later step.

A written table cuts the plan, survives the loss of executors, and keeps columns prunable, which a
checkpointed row stream does not.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Without one, a local folder on a local master only: elsewhere each
    executor would write to a disk of its own, and later reads would miss rows without an error.
    """
    stated = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if stated:
        return stated.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "shopledger")


def is_local(master: str) -> bool:
    """One JVM on this machine; ``local-cluster`` has executors of its own."""
    return master == "local" or master.startswith("local[")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as zstd Parquet and continue from the files."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame, bound: int) -> DataFrame:
    """A table of at most ``bound`` rows, evaluated once; more rows are an error, never cut off."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)


def spent(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing lazy needs any more."""
    hadoop, conf = df.sparkSession._jvm.org.apache.hadoop.fs, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(conf).delete(path, True)
