"""Rows that may have a copy, share an id or belong to a conflicting order are set apart; all others stay where they are."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from shopledger.checks import tables
from shopledger.config import Report
from shopledger.functions import spread
from shopledger.functions.times import parse_time
from shopledger.operators import customers, orders, sales

LINE = "version_id string, source_no int, source_row_id string, order_id string, item_id string, customer_id string, quantity decimal(18,6), day date"
TEXTS = ["item_name", "quantity_text", "unit_price_text", "line_amount_text", "order_amount_text", "currency", "country", "category", "item_type"]


def lines(spark):
    """Two sources that overlap on the 3rd; o3 and the orderless row come twice, o5 has two customers."""
    rows = [
        ("v1", 1, "a", "o1", "A", "c", 1), ("v1", 1, "b", "o2", "A", "c", 2), ("v1", 1, "c", "o3", "A", "c", 3), ("v1", 1, "d", "o5", "A", "c", 4),
        ("v1", 1, "e", "o5", "B", "d", 4), ("v1", 1, "f", None, "A", None, 2), ("v1", 1, "g", None, "A", None, 2), ("v2", 2, "h", "o3", "A", "c", 3),
        ("v2", 2, "i", "o6", None, "c", 5),
    ]
    made = spark.createDataFrame([(v, n, i, o, p, c, None, None) for v, n, i, o, p, c, _ in rows], LINE).drop("quantity", "day")
    days = spark.createDataFrame([(r[2], r[6]) for r in rows], "source_row_id string, dom int")
    made = made.join(days, "source_row_id").withColumns({
        "day": F.make_date(F.lit(2024), F.lit(6), "dom"), "quantity": F.lit(1).cast("decimal(18,6)"), "line_amount": F.lit(1).cast("decimal(38,12)"),
        "record_status": F.lit("forward"), "issues": F.array().cast("array<string>"), **{c: F.lit("USD" if c == "currency" else "x") for c in TEXTS},
    })
    return made.withColumn("event_time", F.col("day").cast("timestamp")).drop("dom")


EXPECTED = {
    "a": "included", "b": "included", "c": "replaced_range", "d": "order_conflict", "e": "order_conflict", "f": "included", "g": "duplicate_removed",
    "h": "duplicate_removed", "i": "missing_item",
}


def test_labels_are_the_same_whatever_the_sieve_catches(spark, monkeypatch):
    report = Report(month="2024-06", merge_mode="replace_overlap", duplicates="drop_exact")
    for bits in (6, spread.SIEVE_BITS):
        monkeypatch.setattr(spread, "SIEVE_BITS", bits)
        labelled = sales.label(lines(spark), tables.mapping(), report)
        assert {r.source_row_id: r.reason for r in labelled.collect()} == EXPECTED


def test_source_ranges_do_not_move_the_rows(spark):
    rows = lines(spark)
    plan = sales.tag_replaced(rows, sales.source_ranges(rows))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [version_id" in plan and "SortMergeJoin [version_id" not in plan


def test_only_repeated_keys_are_surely_caught(spark):
    rows = spark.createDataFrame([(k, k % 900) for k in range(1000)] + [(2000, None), (2001, None)], "k int, v int")
    met = spread.sifted(rows, spread.repeated(rows, ["v"]), ["v"], "hit")
    hits = {r.k for r in met.filter("hit").collect()}
    assert {*range(100), *range(900, 1000), 2000, 2001} <= hits and len(hits) < 210 and met.count() == 1002
    one = spread.sieve(rows.filter("k = 5"), ["k"])
    assert 5 in {r.k for r in spread.sifted(rows, one, ["k"], "hit").filter("hit").collect()}


def test_printed_rows_equal_a_join_to_the_marks(spark):
    """Repeated ids meet every mark of their id, null ids none, as in a join on the id."""
    draw = random.Random(4)
    rows = [(draw.choice("abcdefghijklmnop") + str(draw.randrange(6)), draw.choice("xyz") * draw.randrange(1, 4)) for _ in range(60)] + [(None, "x"), ("z9", None)]
    raw = spark.createDataFrame(rows, "source_row_id string, word string")
    marks = orders.raw_duplicates(raw).select("source_row_id", "duplicate_candidate")
    wanted = raw.join(marks, "source_row_id").select("source_row_id", "word", "duplicate_candidate")
    got = orders.pair_printed(orders.with_print(raw)).select(*wanted.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))


def test_pairing_builds_the_raw_view_once(spark, monkeypatch):
    calls, real = [], tables.raw_lines
    monkeypatch.setattr(tables, "raw_lines", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(tables, "_STORED", {})
    assert tables.paired(spark, "/root/testdata/sf0.001").count() > 6000
    assert len(calls) == 1


def test_nearest_centres_need_no_table_of_all_gaps():
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(100_000, 3)), rng.normal(size=(48, 3))
    centres[40] = centres[2]  # the first of equal centres is named
    tracemalloc.start()
    label, least = customers._nearest(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gaps = ((x[:2000, None, :] - centres[None]) ** 2).sum(2)
    assert (label[:2000] == gaps.argmin(1)).all() and (least[:2000] == gaps.min(1)).all()
    assert peak < 20e6


def test_clock_changes_are_checked_in_generated_code(spark):
    walls = ["2001-03-25 01:30:00", "2001-10-28 01:30:00", "2001-10-28 02:00:00", "2001-07-01 12:00:00", "not a time", None]
    rows = spark.createDataFrame([(w,) for w in walls], "w string")
    parsed = rows.select(parse_time(F.col("w"), "%Y-%m-%d %H:%M:%S", "Europe/London").cast("string").alias("t"))
    assert [r.t for r in parsed.collect()] == [None, None, "2001-10-28 02:00:00", "2001-07-01 11:00:00", None, None]
    assert "lambda" not in parsed._jdf.queryExecution().optimizedPlan().toString()


def test_marked_rows_are_moved_once(spark):
    """Whoever reads the labels reads stored marks; before, every reader sorted and joined the odd rows again."""
    labelled = sales.label(lines(spark), tables.mapping(), Report(month="2024-06", merge_mode="replace_overlap", duplicates="drop_exact"))
    assert "_print" not in labelled._jdf.queryExecution().executedPlan().toString()


def test_admitted_rows_equal_a_join_to_the_audit(spark, monkeypatch):
    """Repeated ids meet every audit row of their id, null ids none; rows with an id of their own are not moved."""
    draw = random.Random(6)
    reasons = ("included", "order_conflict", "outside_scope", "replaced_range", "duplicate_removed", "returned")
    rows = [(draw.choice(("v1", "v2")), draw.choice("abcdefghijklmnop") + str(draw.randrange(9)), k, "forward", draw.choice(reasons)) for k in range(90)]
    rows += [(None, "a1", 90, "forward", "included"), ("v1", None, 91, "forward", "included")]
    labelled = spark.createDataFrame(rows, "version_id string, source_row_id string, k int, record_status string, reason string").withColumn("duplicate_candidate", F.lit(False))
    canonical = labelled.drop("reason", "duplicate_candidate")
    wanted = orders.admit(canonical, labelled).select(*canonical.columns)
    met, admit = [], orders.admit
    monkeypatch.setattr(orders, "admit", lambda c, a: met.append(c.count()) or admit(c, a))
    got = orders.admit_labelled(canonical, labelled)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    assert got.columns == canonical.columns and 0 < met[0] < 75


def test_lines_are_sorted_by_order_only(spark, tmp_path):
    """Lines meet parts without a sort; a part that comes twice doubles its lines, lines without a partner are absent."""
    made = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string", [
            (1, 10, 1, 1, 2.0, 9.5, "N"), (1, 11, 1, 2, 1.0, 3.0, "A"), (2, None, 1, 1, 1.0, 1.0, "N"), (3, 10, 1, 1, 1.0, 1.0, "N"), (None, 10, 1, 1, 1.0, 1.0, "N"), (163, 10, 1, 1, 1.0, 1.0, "N"),
        ]),
        "orders": ("o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz", None),
        "part": ("p_partkey long, p_brand string, p_type string, p_retailprice double", [(10, "Brand#1", "T", 1.0), (11, "Brand#2", "T", 2.0), (11, "Brand#3", "T", 2.0), (None, "Brand#4", "T", 2.0)]),
        "customer": ("c_custkey long, c_nationkey int", [(5, 0), (None, 0)]),
        "nation": ("n_nationkey int, n_name string", [(0, "X")]),
    }
    for name, (schema, rows) in made.items():
        df = spark.createDataFrame(rows, schema) if rows else spark.sql(
            "SELECT col1 AS o_orderkey, col2 AS o_custkey, 5.0D AS o_totalprice, TIMESTAMP'2001-02-03 00:00:00' AS o_orderdate FROM VALUES (1L, 5L), (2L, 5L), (3L, CAST(NULL AS BIGINT)), (163L, 5L)"
        )
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    lines_ = tables.raw_lines(spark, str(tmp_path))
    found = sorted((r.order_id, r.item_name) for r in lines_.collect())
    assert found == [("1", "Item Brand#1"), ("1", "Item Brand#2"), ("1", "Item Brand#3"), ("163", "Item Brand#1"), ("163", "Item Brand#1")]
    plan = lines_._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("ShuffledHashJoin") == 2
