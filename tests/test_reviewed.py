"""Cases that earlier versions got wrong."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shopledger.config import Analysis, Mapping, Report
from shopledger.operators import baskets, forecast, items, orders, recommend
from shopledger.plans import orders as plans
from shopledger.sources import readers, stage

MONTH = Report("2026-09", coverage_start=date(2026, 8, 1), coverage_end=date(2026, 9, 30), complete_coverage=True)


@pytest.mark.parametrize("master, local", [("local", True), ("local[8]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://h:7077", False)])
def test_clusters_need_a_shared_folder(master, local):
    assert stage.is_local(master) is local


def test_calendar_is_not_cut():
    long = Report("2026-09", coverage_start=date(2016, 1, 1), coverage_end=date(2026, 9, 30), complete_coverage=True)
    assert long.calendar_range == (date(2016, 1, 1), date(2026, 9, 30))
    cut = Report("2026-09", coverage_start=date(2016, 1, 1), coverage_end=date(2026, 9, 30), complete_coverage=True, calendar_days=10)
    assert cut.calendar_range == (date(2026, 9, 21), date(2026, 9, 30))


def test_itemset_length_is_checked():
    with pytest.raises(ValueError):
        Analysis(max_length=4)


def test_price_volume_keeps_digits_and_size(spark):
    rows = [("fine", date(2026, 8, 5), "2.500001", "3.000049"), ("fine", date(2026, 9, 5), "2.500001", "6.000099"), ("huge", date(2026, 8, 5), "20000000000", "7"), ("huge", date(2026, 9, 5), "20000000000", "9"), ("half", date(2026, 8, 5), "1", "0.01"), ("half", date(2026, 9, 5), "2", "0.02")]
    daily = spark.createDataFrame(rows, "item_id string, day date, q string, a string").select("item_id", "day", F.col("q").cast("decimal(38,12)").alias("quantity"), F.col("a").cast("decimal(38,12)").alias("amount"), F.lit(0).alias("amount_missing"))
    got = {r.item_id: r for r in items.price_volume(daily, MONTH).collect()}
    assert got["fine"].previous_amount == pytest.approx(3.000049, abs=1e-12) and got["fine"].quantity_effect == 0 and got["fine"].price_effect == 3.0
    assert got["huge"].current_quantity == 2e10 and got["huge"].quantity_effect == 0 and got["huge"].price_effect == 2.0
    assert got["half"].quantity_effect == 0.01 and got["half"].price_effect == 0.0


def test_unpaired_rows_are_errors(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "source_row_id string, v string")
    assert orders.pair_raw(rows, rows).count() == 2
    for left, right in ((rows.limit(1), rows), (rows, rows.limit(1))):
        with pytest.raises(Exception, match="differ"):
            orders.pair_raw(left, right).collect()


def test_fingerprint_sees_where_a_null_stands(spark):
    rows = spark.createDataFrame([("v1", "a", None), ("v2", None, "a")], "version_id string, x string, y string")
    prints = readers.fingerprint(rows)
    assert prints.select("hash_xor").distinct().count() == 2 and readers.repeated_sources(prints).isEmpty()


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"x\ny",1\nz,2\n', encoding="utf-8")
    before = spark.conf.get("spark.sql.csv.parser.columnPruning.enabled")
    found = readers.read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"], multi_line=True)
    assert sorted(map(tuple, found.collect())) == [("x\ny", "1"), ("z", "2")]
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == before


def test_content_ids_tell_equal_rows_apart(spark):
    rows = spark.createDataFrame([("a", None), (None, "a"), ("a", None), ("a", None)], "x string, y string")
    ids = [r.source_row_id for r in readers.with_content_id(rows).collect()]
    assert len(set(ids)) == 4 and len({i.split(":")[0] for i in ids}) == 2


def test_cancelled_rows_follow_the_mapping(spark):
    mapping = Mapping(time_format="%Y-%m-%d", status_rule="status_column", status_values={"void": "cancelled", "ok": "forward"})
    rows = spark.createDataFrame([("void", "2026-09-01"), ("ok", "2026-09-01"), ("C", "2026-09-01")], "record_status string, event_time string").withColumns({c: F.lit("1") for c in ("order_id", "customer_id", "quantity", "unit_price")})
    assert readers.table_profile(rows, mapping).first().cancelled_rows == 1


def test_an_old_gap_does_not_stop_publication(spark):
    values = [1.0 + k % 3 for k in range(200)]
    values[60] = None
    rows = spark.createDataFrame([("gap", 0, values), ("late gap", 0, [*values[:190], None, *values[191:]])], "item_id string, first int, values array<double>")
    now = forecast.simple_forecasts(rows, [200], need_target=False).collect()
    assert [r.item_id for r in now] == ["gap"] and now[0].last_week == sum(values[-7:])
    assert forecast.simple_forecasts(rows, [190]).count() == 0


def test_boosted_models_of_several_origins(spark):
    start = date(2026, 1, 1)
    grid = spark.createDataFrame([(f"i{k}", t, start + timedelta(days=t), float((t * (k + 3)) % 11)) for k in range(12) for t in range(120)], "item_id string, t int, day date, quantity double")
    features = forecast.trailing_features(forecast.with_next_day(grid, 120)).cache()
    keys = grid.select("item_id").distinct()
    found = forecast.boosted_forecasts(features, keys, [106, 113], trees=2)
    assert {r.origin for r in found.collect()} == {106, 113} and found.count() == 24
    last = forecast.gbt_forecast(features, keys, 120, trees=2)
    assert last.count() == 12 and last.filter("gradient_boosting < 0").isEmpty()


def test_cards_equal_a_plain_walk(spark):
    rows, k = [], 0
    for a in range(9):
        for b in range(9):
            if a != b:
                k = (k * 7 + 11) % 97
                rows.append(([f"i{a}"], [f"i{b}"], f"i{a}", f"i{b}", k / 97, 0.1, 30, 1.5))
    rules = spark.createDataFrame(rows, "antecedent_items array<string>, consequent_items array<string>, antecedents string, consequents string, confidence_lower double, leverage double, n_ab int, lift double")
    shown, used, seen = [], {}, set()
    for r in sorted(rows, key=lambda r: (-r[4], -r[5], -r[6], -r[7], r[2], r[3])):
        s = frozenset(r[0] + r[1])
        if s not in seen and all(used.get(i, 0) < 3 for i in s) and len(shown) < 10:
            shown.append((r[2], r[3]))
            seen.add(s)
            used |= {i: used.get(i, 0) + 1 for i in s}
    assert [(r["antecedents"], r["consequents"]) for r in baskets.cards(rules, 10, 3)] == shown


def test_steps_lose_for_covered_items_without_a_cap(spark):
    pool = [(f"p{k:03}", "pairing", 1.0 - k / 1000, ["a", f"b{k}"]) for k in range(120)] + [("x", "sales", 2.0, ["a"]), ("y", "customer", 0.01, [])] + [("free", "pairing", 0.86, ["c", "d"])]
    found = recommend.combine(spark.createDataFrame(pool, "id string, strategy string, score double, related_items array<string>")).orderBy("place").collect()
    assert [r.id for r in found] == ["x", "free", "y"]


def test_intervals_resample_the_right_blocks(spark):
    rows = spark.createDataFrame([("1", "a", "c1", "2026-09-01"), ("2", "b", None, "2026-09-02")], "order_id string, item_id string, customer_id string, t string").withColumn("event_time", F.col("t").cast("timestamp"))
    labels = lambda mode: rows.select("order_id", F.lit(mode).alias("split_mode"))
    assert plans.bootstrap_block(rows.filter("customer_id is not null"), labels("chronological"))[1] == "customer_id"
    owners, block = plans.bootstrap_block(rows, labels("chronological"))
    assert block == "week" and owners.select("week").distinct().count() == 1
    assert plans.bootstrap_block(rows, labels("random"))[1] == "order_id"




def test_recommendations_equal_all_rules_read(spark):
    """Only an antecedent's first items become rows; the lists are those of all rules, ties and repeated strengths included."""
    draw = random.Random(3)
    goods = [f"i{k:02d}" for k in range(14)]
    rules = []
    for _ in range(160):
        a = sorted(draw.sample(goods, draw.choice([1, 1, 2])))
        b = sorted(draw.sample([g for g in goods if g not in a], draw.choice([1, 2])))
        rules.append((a, b, draw.choice([0.1, 0.2, 0.3]), draw.choice([1.0, 1.5]), draw.choice([20, 30])))
    known = {f"o{k}": draw.sample(goods, draw.randint(1, 6)) for k in range(60)}
    qualified = spark.createDataFrame(rules, "antecedent_items array<string>, consequent_items array<string>, confidence_lower double, lift double, n_ab long")
    pairs = spark.createDataFrame([(o, i) for o, items in known.items() for i in items], "order_id string, item_id string")
    wanted = set()
    for o, items in known.items():
        best = {}
        for a, b, *s in rules:
            for i in set(b) - set(items) if set(a) <= set(items) else ():
                best[i] = max(best.get(i, s), s)
        ranked = sorted(best, key=lambda i: ([-v for v in best[i]], i))[:5]
        wanted |= {(o, i, r + 1) for r, i in enumerate(ranked)}
    got = baskets.recommend(pairs, qualified)
    assert {tuple(r) for r in got.collect()} == wanted
    # a basket moves once, no row per rule is sorted (a sort aggregate spilled with baskets times rules before)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "BroadcastHashJoin" in plan
    assert baskets.recommend(pairs.limit(0), qualified).count() == 0 == baskets.recommend(pairs, qualified.limit(0)).count()
