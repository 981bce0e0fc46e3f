"""Known answers on small fixtures that the shared tables do not hold."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shopledger.config import FIELDS, Mapping, Report
from shopledger.functions import spread
from shopledger.functions.money import money
from shopledger.functions.times import parse_time
from shopledger.operators import anomaly, baskets, customers, evidence, forecast, items, recommend, sales
from shopledger.operators.normalize import normalize
from shopledger.sources import readers
from shopledger.sources.stage import fresh_path

MONTH = Report("2026-09", coverage_start=date(2026, 8, 1), coverage_end=date(2026, 9, 30), complete_coverage=True)


def canonical(spark, rows, **fixed):
    base = {"item_id": "A", "event_time": "2026-09-02", "quantity": "3", "currency": "CNY"}
    data = []
    for number, row in enumerate(rows):
        full = {**base, **fixed, **row}
        data.append((full.get("v", "v1"), full.get("no", 1), f"r{number:04}", *[full.get(f) for f in FIELDS]))
    schema = "version_id string, source_no int, source_row_id string, " + ", ".join(f"{f} string" for f in FIELDS)
    return spark.createDataFrame(data, schema)


def label(spark, rows, report=MONTH, mapping=None, **fixed):
    setting = mapping or Mapping(time_format="%Y-%m-%d")
    return sales.label(normalize(canonical(spark, rows, **fixed), setting), setting, report), setting


def test_money_domain(spark):
    texts = ["1e3", " 12 ", "NaN", "1_000", "0.1234567", "0.1234560", "12,5", "-0.5", ".5", "1234567890123", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r.m for r in rows.orderBy("i").select(money(F.col("t")).alias("m")).collect()]
    assert [None if v is None else float(v) for v in found] == [1000, 12, None, 1000, None, 0.123456, None, -0.5, 0.5, None, None]


@pytest.mark.parametrize("text, zone, expected", [
    ("2026-03-29T01:30:00", "Europe/London", None),
    ("2026-10-25T01:30:00", "Europe/London", None),
    ("2026-10-25T01:30:00+01:00", "Europe/London", "2026-10-25 00:30:00"),
    ("2026-07-01T12:00:00", "Europe/London", "2026-07-01 11:00:00"),
    ("2026-04-05T01:45:00", "Australia/Lord_Howe", None),
    ("2026-09", "UTC", None),
    ("2026-09-30", "UTC", "2026-09-30 00:00:00"),
])
def test_wall_times(spark, text, zone, expected):
    row = spark.range(1).select(parse_time(F.lit(text), "iso8601", zone).cast("string").alias("t")).first()
    assert row.t == expected


def test_rows_are_typed_in_generated_code(spark):
    """Clocks are converted once a row, tags need no lambda, and odd values are typed as ever."""
    zoned = Mapping(time_format="%Y-%m-%d %H:%M:%S", timezone="Europe/London", status_rule="status_column", status_values={"N": "forward"})
    rows = [
        {"event_time": "2026-07-01 12:00:00", "quantity": "0012.50", "currency": " usd"}, {"event_time": "2026-3-29 01:30:00", "quantity": "1_0"},
        {"event_time": "2026-10-25 01:30:00", "quantity": "+3", "currency": "U\u0131a"}, {"event_time": "2026-10-25 01:30", "quantity": "-01", "currency": "us"},
        {"event_time": None, "quantity": None, "currency": None, "record_status": None, "item_id": " "}, {"event_time": "2026-02-30 01:00:00", "quantity": "0"},
    ]
    typed = normalize(canonical(spark, rows, record_status="N", order_id="o", customer_id="c"), zoned)
    found = typed.orderBy("source_row_id").select(F.col("event_time").cast("string"), F.col("day").cast("string"), "quantity_text", F.col("quantity").cast("double"), "currency", "issues").collect()
    assert [tuple(r) for r in found] == [
        ("2026-07-01 11:00:00", "2026-07-01", "12.50", 12.5, "USD", []), (None, None, "10", 10, "CNY", ["invalid_time"]),
        (None, None, "3", 3, "UIA", ["invalid_time"]), (None, None, "-1", -1, None, ["invalid_time", "nonpositive_quantity", "unknown_currency"]),
        (None, None, None, None, None, ["missing_item", "invalid_time", "unknown_status", "invalid_quantity", "unknown_currency"]),
        (None, None, "0", 0, "CNY", ["invalid_time", "nonpositive_quantity"]),
    ]
    assert "lambda" not in typed._jdf.queryExecution().executedPlan().toString()
    stages = spark.range(1).select(parse_time(F.col("id").cast("string"), "%Y-%m-%d %H:%M:%S", "Europe/London").alias("t"))._jdf.queryExecution().debug().codegenToSeq()
    code = "".join(stages.apply(i)._2() for i in range(stages.size()))
    assert code.count(".convertTz(") == 4


def test_unknown_is_not_zero(spark):
    open_month = Report("2026-09")
    rows, setting = label(spark, [{"line_amount": "0.30"}], open_month)
    daily = sales.daily_fact(rows, setting)
    month = sales.month_totals(rows, setting, open_month).filter("month = '2026-09'").first()
    assert (month.quantity, month.amount, month.orders) == (3, 0.3, None)
    chart = {r.day.day: r.quantity for r in sales.store_chart(daily, open_month).collect()}
    assert chart[2] == 3 and chart[1] is None


def test_missing_amount_stays_unknown(spark):
    rows, setting = label(spark, [{"line_amount": "5"}, {"line_amount": None, "item_id": "B"}])
    assert sales.month_totals(rows, setting, MONTH).filter("month = '2026-09'").first().amount is None


def test_overlapping_sources(spark):
    lines = [{"quantity": "3"}, {"quantity": "4", "v": "v2", "no": 2}]
    rows = normalize(canonical(spark, lines), Mapping(time_format="%Y-%m-%d"))
    with pytest.raises(ValueError, match="overlapping_sources"):
        sales.check_append(sales.source_ranges(rows))
    newest = Report(**{**MONTH.__dict__, "merge_mode": "replace_overlap"})
    labelled, setting = label(spark, lines, newest)
    assert sorted(r.reason for r in labelled.collect()) == ["included", "replaced_range"]
    assert sales.daily_fact(labelled, setting).first().quantity == 4


def test_order_total_counts_once(spark):
    setting = Mapping(time_format="%Y-%m-%d", amount_mode="order_amount")
    rows, _ = label(spark, [{"order_id": "o"}, {"order_id": "o", "item_id": "B"}], mapping=setting, order_amount="10")
    month = sales.month_totals(rows, setting, MONTH).filter("month = '2026-09'").first()
    assert (month.amount, month.orders) == (10, 1)


def test_number_text_separates_duplicates(spark):
    rows, _ = label(spark, [{"quantity": "1.0"}, {"quantity": "1"}, {"quantity": "1"}])
    assert [r.duplicate_candidate for r in rows.orderBy("source_row_id").collect()] == [False, False, True]


def test_hot_copies_are_marked_once(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") < 4000, F.lit("x")).otherwise(F.col("id").cast("string")).alias("c"))
    marked = spread.mark_repeats(rows, ["c"], ["k"], "again")
    assert marked.filter("not again").agg(F.count("k"), F.min("k")).first() == (1001, 0)


def test_attach_lets_adaptive_execution_split_hot_keys(spark):
    changed = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
        facts = rows.groupBy("k").agg(F.count("id").alias("n"))
        joined = spread.attach(rows, facts, ["k"])
        assert joined.filter("k = 7").select("n").distinct().first().n == 20001
        joined.write.format("noop").mode("overwrite").save()
        total = joined.agg(F.count(F.lit(1))).first()[0]
        assert total == 60000
        exchanges = joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(k")
        assert exchanges >= 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_exact_quantiles_and_running_totals(spark):
    values = [1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 5.0)], "g string, v double")
    found = {r.g: r.q for r in spread.exact_quantiles(df, "v", {"q": 0.75}, ["g"]).collect()}
    assert found == {"g": 4.75, "h": 5.0}
    ranks = spread.totals_above(spark.createDataFrame([(5.0,), (5.0,), (9.0,), (1.0,)], "v double"), "v", {"n": F.count("v")})
    assert {r.v: (r.n, r.n_before, r.n_total) for r in ranks.collect()} == {9.0: (1, 0, 4), 5.0: (2, 1, 4), 1.0: (1, 3, 4)}


def test_half_even_cents(spark):
    row = spark.range(1).select(
        *[items.half_even_cents(F.lit(n).cast("decimal(18,4)"), F.lit(2).cast("decimal(9,0)")).cast("int").alias(c)
          for c, n in (("a", "0.0100"), ("b", "0.0300"), ("c", "-0.0300"), ("d", "0.0101"))]
    ).first()
    assert tuple(row) == (0, 2, -2, 1)


def test_gap_days(spark):
    report = Report("2026-09", coverage_start=date(2026, 9, 1), coverage_end=date(2026, 9, 30), complete_coverage=True, closed_dates=(date(2026, 9, 20),))
    sold = [d for d in range(1, 31) if d not in (5, 6, 10, 11, 12, 19, 20, 21)]
    daily = spark.createDataFrame([(date(2026, 9, d), "A") for d in sold], "day date, item_id string")
    assert sorted(r.day.day for r in sales.gap_days(daily, report).collect()) == [10, 11, 12]


def test_ragged_csv_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "x.csv"), ["a", "b"]).count()


def test_empty_basket_item_fails(spark):
    df = spark.createDataFrame([("r1", "a| |c")], "row string, goods string")
    with pytest.raises(Exception, match="empty_basket_item"):
        readers.explode_baskets(df, "row", "goods").collect()


def test_regular_customers_are_listed(spark):
    rows = [(f"c{i:02}", f"{i}-{d}", f"2026-10-{d:02} 00:00:00") for i in range(20) for d in (1, 5, 9, 13)]
    rows += [("irregular", f"x{d}", f"2026-10-{d:02} 00:00:00") for d in (1, 2, 12, 13)] + [("recent", f"y{d}", f"2026-10-{d:02} 00:00:00") for d in (17, 21, 25, 29)]
    rows += [("later", "z", "2026-11-05 00:00:00")]
    orders = spark.createDataFrame(rows, "customer_id string, order_id string, t string").withColumn("event_time", F.col("t").cast("timestamp"))
    found = customers.followups(orders, date(2026, 11, 1))
    assert found.count() == 20
    one = found.first()
    assert (one.usual_gap_days, one.days_since_purchase) == (4.0, 19)
    assert customers.followup_summary(found, 100).first().customers == 20
    assert customers.followup_summary(found.filter("customer_id = 'c01'"), 1).isEmpty()


def days_of(values, first=date(2026, 9, 1)):
    return [(first + timedelta(days=k), float(v)) for k, v in enumerate(values)]


SERIES = "item_id string, daily array<struct<date:date,quantity:double>>, anomalies array<struct<date:date,actual:double,reference:double>>"


def test_trend_and_spike(spark):
    rising = [2.0, 2.0] + [3.0] * 7 + [4.0] * 7 + [5.0] * 7 + [6.0] * 7
    burst = [4.0, 5.0] * 12 + [60.0] + [4.0] * 5
    rows = [("up", days_of(rising), []), ("flat", days_of([5.0] * 30), []), ("burst", days_of(burst), [(date(2026, 9, 25), 60.0, 5.0)])]
    shown = spark.createDataFrame(rows, SERIES)
    trends = evidence.trend4(shown, MONTH).collect()
    assert [(t.item_id, t.signal, t.week1, t.week4) for t in trends] == [("up", "growth", 21.0, 42.0)]
    month = spark.createDataFrame([("burst", 188.0)], "item_id string, quantity double")
    spikes = evidence.spike(shown, month, MONTH).collect()
    assert [(s.item_id, s.baseline, s.quantity_impact) for s in spikes] == [("burst", 5.0, 55.0)]


def test_focus_is_diversified(spark):
    rows = [(f"i{k}", "leader", 100.0 - k) for k in range(12)] + [(f"g{k}", "growth", 60.0 - k) for k in range(12)]
    found = evidence.focus(spark.createDataFrame(rows, "item_id string, category string, score double")).orderBy("place").collect()
    pool, chosen = list(rows), [rows[0]]
    while len(chosen) < 5:  # brute force over all candidates
        used, cats = {c[0] for c in chosen}, [c[1] for c in chosen]
        chosen.append(min((c for c in pool if c[0] not in used), key=lambda c: (-c[2] * 0.45 ** cats.count(c[1]), c[0], c[1])))
    assert [r.item_id for r in found] == [c[0] for c in chosen]


def test_combine_penalises_overlap(spark):
    rows = [("a1", "sales-growth", 0.9, ["x"]), ("p1", "pairing", 0.8, ["x", "y"]), ("p2", "pairing", 0.7, ["u", "v"]), ("c", "customer-followup", 0.1, [])]
    found = recommend.combine(spark.createDataFrame(rows, "id string, strategy string, score double, related_items array<string>"))
    assert [r.id for r in found.orderBy("place").collect()] == ["a1", "p2", "c"]


def test_planted_pair_qualifies(spark):
    orders = []
    for k in range(1000):
        basket = ["A", "B"] if k % 10 < 2 else ["C"] if k % 10 < 6 else ["D", "E"] if k % 10 < 8 else ["A"] if k % 10 == 8 else ["B"]
        orders += [(f"o{k:04}", item, date(2026, 1, 1) + timedelta(days=k // 10)) for item in basket]
    df = spark.createDataFrame(orders, "order_id string, item_id string, day date").withColumn("event_time", F.col("day").cast("timestamp"))
    labels = baskets.split(df)
    assert {r["split"]: r["count"] for r in labels.groupBy("split").count().collect()} == {"train": 600, "validation": 200, "test": 200}
    pairs = baskets.baskets(df).join(labels, "order_id")
    train, valid = pairs.filter("split = 'train'"), pairs.filter("split = 'validation'")
    rules = baskets.rules(baskets.itemsets(train.select("order_id", "item_id"), 600), 600)
    found = {(r.antecedents, r.consequents) for r in baskets.qualify(rules, valid.select("order_id", "item_id")).collect()}
    assert found == {("A", "B"), ("B", "A"), ("D", "E"), ("E", "D")}


def test_injected_anomaly_is_found(spark):
    report = Report("2026-09", coverage_start=date(2026, 6, 1), coverage_end=date(2026, 9, 30), complete_coverage=True)
    odd = date(2026, 9, 19)
    grid = spark.range(12).select(F.concat(F.lit("i"), "id").alias("item_id"), F.posexplode(F.sequence(F.lit(report.coverage_start), F.lit(report.month_end))).alias("t", "day"))
    noise = F.pmod(F.xxhash64("item_id", "t"), F.lit(7)) + 7
    grid = grid.withColumn("quantity", F.when((F.col("item_id") == "i0") & (F.col("day") == F.lit(odd)), 150.0).otherwise(noise.cast("double")))
    found = anomaly.anomalies(anomaly.measured_days(grid, report), report).collect()
    assert ("i0", odd) in {(r.item_id, r.date) for r in found}


def test_no_label_reaches_past_the_origin():
    plan = forecast.Plan.for_days(123)
    assert plan.origins[-1] + forecast.HORIZON == 123 and len(plan.origins) == plan.validation + plan.calibration + 3
    assert (forecast.Plan.for_days(400).validation, forecast.Plan.for_days(400).calibration) == (12, 20)


def test_staged_path_is_below_the_shared_folder(spark):
    assert fresh_path(spark, "x").rsplit("/", 1)[1].startswith("x-")
