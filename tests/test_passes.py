"""What several steps read is worked out once, and no step sorts or leaves generated code for it."""

from datetime import date

from pyspark.sql import functions as F
from test_plans import MAPPING, lines, report, source
from test_sieve import EXPECTED
from test_sieve import lines as two_sources

from shopledger.checks import models, months, tables
from shopledger.config import Report
from shopledger.operators import normalize, sales
from shopledger.plans import monthly


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_of_a_report_are_written_once(spark, monkeypatch):
    whole = source(spark, lines(181)).unionByName(source(spark, lines(181)[:40], name="v2", number=2)).cache()
    parts = [(whole.filter(F.col("version_id") == v), MAPPING) for v in ("v1", "v2")]
    names, write = [], monthly.staged
    monkeypatch.setattr(monthly, "staged", lambda df, name: names.append(name) or write(df, name))
    settings = report(merge_mode="replace_overlap", duplicates="drop_exact")
    copied = monthly.monthly_report(parts, settings, trees=0)
    assert names.count("labelled") == names.count("names") == names.count("source-rows") == 1
    names.clear()
    month = monthly.monthly_report(parts, settings, trees=0, stored=whole)
    assert names.count("labelled") == 1 and "source-rows" not in names
    for name in ("labelled", "rows"):
        assert "Join" not in plan(month[name]) and month[name].inputFiles()
        shown = [sorted(map(str, m[name].select("version_id", "source_row_id", *(["reason"] if name == "labelled" else [])).collect())) for m in (copied, month)]
        assert shown[0] == shown[1]
    assert month["rows"].columns == whole.columns and month["rows"].count() == whole.count()


def shop(spark, folder):
    """Some hundred orders of three lines each, from the start of 2001 on."""
    made = {
        "nation": spark.range(3).selectExpr("CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name"),
        "customer": spark.range(40).selectExpr("id AS c_custkey", "CAST(id % 3 AS INT) AS c_nationkey"),
        "part": spark.range(8).selectExpr("id AS p_partkey", "concat('Brand#', id) AS p_brand", "'T' AS p_type", "10.0D AS p_retailprice"),
        "orders": spark.range(1, 400).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey", "30.0D AS o_totalprice", "CAST(date_add(DATE '2001-01-01', CAST(id % 200 AS INT)) AS TIMESTAMP) AS o_orderdate"),
        "lineitem": spark.range(1, 400).selectExpr("id AS l_orderkey", "explode(array(0, 1, 2)) AS k").selectExpr(
            "l_orderkey", "(l_orderkey + k * k) % 8 AS l_partkey", "1L AS l_suppkey", "CAST(k + 1 AS INT) AS l_linenumber", "2.0D AS l_quantity", "10.0D + k AS l_extendedprice", "'N' AS l_returnflag",
        ),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_rows_of_the_month_and_follow_ups_are_read_from_files(spark, tmp_path):
    folder = shop(spark, tmp_path)
    items = months.included(spark, folder)
    assert "Join" not in plan(items) and items.inputFiles()
    assert items.count() == tables.labelled(spark, folder).filter("reason = 'included'").count() > 0
    assert "lag(" not in plan(models.regular_summary(spark, folder))
    for df in (models.counted(spark, folder), models.split_pairs(spark, folder, "train"), tables.order_times(spark, folder)):
        assert "Join" not in plan(df)


def test_kinds_are_hashed_by_item(spark):
    rows = spark.createDataFrame(
        [("a", "physical"), ("a", "实物"), ("b", "费用"), ("b", "physical"), ("c", "x"), ("c", None), ("d", " accounting "), (None, "服务")], "item_id string, item_type string",
    )
    kinds = normalize.item_types(rows, Report(month="2024-06", item_types={"c": "physical"}))
    assert "SortAggregate" not in plan(kinds)
    assert {tuple(r) for r in kinds.collect()} == {
        ("a", "physical", "mapped_source_field"), ("b", "unknown", "conflicting_types"), ("c", "physical", "user_mapping"),
        ("d", "accounting", "mapped_source_field"), (None, "fee_service", "mapped_source_field"),
    }


def test_few_ranges_need_no_lambda(spark):
    day = lambda n: date(2024, 6, n) if n else None
    ranges = spark.createDataFrame([("v1", 1, day(1), day(9)), ("v2", 2, day(3), day(4)), ("v3", 3, day(8), day(9))], "version_id string, source_no int, start date, end date")
    rows = spark.createDataFrame([(v, day(n)) for v in ("v1", "v2", "v3", "v4", None) for n in (None, 1, 3, 4, 5, 8, 9)], "version_id string, day date")
    few, many = sales.tag_replaced(rows, ranges, 3), sales.tag_replaced(rows, ranges)
    assert "lambdafunction" in plan(many) and "lambdafunction" not in plan(few)
    found = {tuple(r) for r in few.collect()}
    assert found == {tuple(r) for r in many.collect()}
    assert {r[:2] for r in found if r[2]} == {("v1", day(n)) for n in (3, 4, 8, 9)} | {("v2", day(n)) for n in (8, 9)}


def test_rows_that_differ_in_a_name_only_are_no_copies(spark):
    settings = Report(month="2024-06", merge_mode="replace_overlap", duplicates="drop_exact")
    for field in set(sales.CONTENT) - set(sales.COPIED) - {"line_amount"}:
        rows = two_sources(spark).withColumn(field, F.when(F.col("source_row_id").isin("g", "h"), "other").otherwise(F.col(field)))
        labelled = {r.source_row_id: r.reason for r in sales.label(rows, tables.mapping(), settings).collect()}
        assert labelled == EXPECTED | {"g": "included", "h": "included"}, field
