"""Run registered queries against their SQL on DuckDB: ``python tests/compare.py SF [prefix ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return bool(value) if isinstance(value, bool) else value


def records(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(plain(r[i])) for i in order) for r in rows))


def compare(spark, con, name, build, sql, sf_dir):
    """(ok, message) of one query."""
    started = time.time()
    df = build(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return True, f"{name}: rows only, {len(mine)} rows, {took:.1f}s", took
    started = time.time()
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = result.fetchall()
    note = f"{took:.1f}s / {time.time() - started:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} against {sorted(names)}", took
    a, b = records(df.columns, mine), records(names, theirs)
    if a == b:
        return True, f"{name}: ok, {len(a)} rows, {note}", took
    only_a = [x for x in a if x not in set(b)][:4]
    only_b = [x for x in b if x not in set(a)][:4]
    return False, f"{name}: DIFFERENT {len(a)} against {len(b)} rows, {note}\n  spark {only_a}\n  sql   {only_b}", took


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = session(), database(folder)
    sqls = entry.oracle_sql()
    for key, build in entry.queries().items():
        if len(sys.argv) > 2 and not any(key.startswith(p) for p in sys.argv[2:]):
            continue
        try:
            print(compare(spark, con, key, build, sqls.get(key), folder)[1], flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{key}: ERROR {type(error).__name__} {str(error)[:700]}", flush=True)
