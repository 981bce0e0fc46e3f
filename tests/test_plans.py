"""Whole plans on small sources: complete, incomplete and summary months, and the way to next steps."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shopledger.config import FIELDS, Analysis, Mapping, Report
from shopledger.operators import normalize
from shopledger.plans import monthly, steps
from shopledger.sources.readers import canonicalize

START = date(2026, 1, 1)
MAPPED = {f: f if f in ("order_id", "item_id", "item_name", "customer_id", "event_time", "quantity", "line_amount", "currency") else None for f in FIELDS}
MAPPING = Mapping(columns=MAPPED, quantity_unit="piece", time_format="%Y-%m-%d", timezone="UTC")


def lines(days, skip=()):
    """Orders of three days in four by twenty items; two of them always together, one item rising, one falling; thirty customers buy every fifth day."""
    rows, number = [], 0
    for t in range(days):
        day = START + timedelta(days=t)
        if day in skip:
            continue
        for k in range(12):
            number += 1
            who = f"c{(k * 5 + t) % 60:02}" if not (k < 3 and t > days - 40) else f"late{k}"
            goods = [f"i{(number * 7 + k) % 20:02}"] + (["pairA", "pairB"] if (t + k) % 4 == 0 else ["pairA"] if k == 1 and t % 9 == 0 else ["pairB"] if k == 2 and t % 9 == 0 else [])
            week = max(0, (t - (days - 28)) // 7)
            goods += ["up"] * (k == 0) + ["down"] * (k == 1)
            for g in goods:
                q = 6 + 10 * week if g == "up" else 40 - 9 * week if g == "down" else 1 + (number + len(g)) % 4
                rows.append((f"r{number}-{g}", f"o{number}", g, f"Item {g}", who, day.isoformat(), str(q), f"{q * 3}.50", "EUR"))
    return rows


def source(spark, rows, mapping=MAPPING, name="v1", number=1):
    columns = ["source_row_id", "order_id", "item_id", "item_name", "customer_id", "event_time", "quantity", "line_amount", "currency"]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    return normalize.normalize(canonicalize(raw, mapping), mapping).withColumns({"version_id": F.lit(name), "source_no": F.lit(number)})


def report(**changes):
    settings = dict(month="2026-06", coverage_start=START, coverage_end=date(2026, 6, 30), complete_coverage=True)
    return Report(**{**settings, **changes})


@pytest.fixture(scope="module")
def whole(spark):
    rows = source(spark, lines(181)).cache()
    return rows, monthly.monthly_report([(rows, MAPPING)], report(), trees=3)


def test_a_complete_month(whole):
    month = whole[1]
    flags = {r.item_id: r["flags"] for r in month["flags"].collect()}
    assert "growth" in flags["up"] and "decline" in flags["down"]
    focus = {r.item_id: r.category for r in month["focus"].collect()}
    assert focus["up"] in ("growth", "leader") and len(focus) == 5
    # the days of the steep rise are anomalies themselves, so only the fall is a lasting trend
    assert "down" in {r.item_id for r in month["actions"].collect()}
    assert "gradient_boosting" in {r.method for r in month["errors"].collect()}
    assert month["forecast"].filter("quantity is not null").count() > 0
    assert month["overview"].count() == month["items"].count() and 0 < month["drivers"].count() <= 5


def test_an_incomplete_month_ranks_but_does_not_compare(spark):
    rows = source(spark, [r for r in lines(181) if r[5] <= "2026-06-17"])
    month = monthly.monthly_report([(rows, MAPPING)], report(coverage_end=date(2026, 6, 17)), trees=0)
    flags = month["flags"].collect()
    assert {r.status for r in flags} == {"missing_records"} and not any({"growth", "decline", "anomaly"} & set(r["flags"]) for r in flags)
    assert {r.category for r in month["focus"].collect()} == {"leader"} and month["actions"].isEmpty()
    assert {r.code for r in month["eligibility"].collect()} == {"month_incomplete"} and {r.status for r in month["anomaly_status"].collect()} == {"insufficient"}
    chart = {r.date.isoformat() if hasattr(r.date, "isoformat") else r.date: r.quantity for r in month["chart"].select(F.col(month["chart"].columns[0]).alias("date"), "quantity").collect()}
    assert chart["2026-06-17"] > 0 and chart["2026-06-18"] is None


def test_closed_days_block_the_weekly_comparison(spark):
    closed = date(2026, 6, 25)
    rows = source(spark, lines(181, skip={closed}))
    month = monthly.monthly_report([(rows, MAPPING)], report(closed_dates=(closed,)), trees=0)
    assert {r.status for r in month["flags"].collect()} == {"closed"}
    assert "growth" not in {r.category for r in month["focus"].collect()}


def test_unexplained_gaps_are_unknown(spark):
    gap = {date(2026, 6, d) for d in (22, 23, 24)}
    rows = source(spark, lines(181, skip=gap))
    month = monthly.monthly_report([(rows, MAPPING)], report(), trees=0)
    assert {r.status for r in month["flags"].collect()} == {"missing_records"}
    assert {r.status for r in month["anomaly_status"].collect()} <= {"insufficient", "clear", "detected"}


def test_summaries_compare_whole_months(spark):
    def month_rows(month, factor):
        rows = [(f"{month}-{g}", None, g, f"Item {g}", None, None, str(q), f"{q * 2}.00", "EUR") for g, q in (("a", 40 * factor), ("b", 30), ("c", 20), ("d", 2))]
        mapping = Mapping(columns=MAPPED, quantity_unit="piece", record_kind="monthly_summary", summary_month=month, order_boundary="unavailable")
        return source(spark, rows, mapping, month, int(month[-1])), mapping

    month = monthly.monthly_report([month_rows("2026-05", 1), month_rows("2026-06", 2)], report(), trees=0)
    flags = {r.item_id: (r.status, r["flags"]) for r in month["flags"].collect()}
    assert flags["a"] == ("available", ["growth"]) and flags["b"][0] == "available"
    assert [(r.item_id, r.category) for r in month["focus"].orderBy("place").collect()][:2] == [("a", "leader"), ("b", "leader")]
    alone = monthly.monthly_report([month_rows("2026-06", 2)], report(coverage_start=date(2026, 6, 1)), trees=0)
    assert {r.status for r in alone["flags"].collect()} == {"missing_records"} and {r.category for r in alone["focus"].collect()} == {"leader"}


def test_from_report_to_next_steps(spark, whole, tmp_path):
    rows, month = whole
    ledger, settings = str(tmp_path / "runs"), Analysis(k_max=3, n_init=2)
    stock = spark.createDataFrame(
        [(f"i{k:02}", date(2026, 7, 1), 5.0, 1.0, 0.0, None, 4.0, True, True) for k in range(20)],
        "item_id string, snapshot_date date, reserve double, available double, incoming double, arrival_date date, pack_size double, confirmed boolean, physical_confirmed boolean",
    )
    found = steps.next_steps(month, [MAPPING], report(), ledger, datetime(2026, 7, 1), settings, stock, publishable=True)
    assert found["admitted"].count() == month["audit"].filter("reason not in ('outside_scope', 'replaced_range', 'duplicate_removed')").count()
    assert {tuple(sorted(r.related_items)) for r in found["pairings"].collect()} >= {("pairA", "pairB")}
    kinds = {r.kind for r in found["runs"].collect()}
    assert "association" in kinds
    chosen = [r.strategy for r in found["steps"].orderBy("place").collect()]
    assert "pairing" in chosen and any(s.startswith("sales-") for s in chosen) and len(chosen) == len(set(chosen))
    ordered = {r.item_id: r for r in found["stock"].collect()}
    published = {r.item_id: r for r in month["forecast"].filter("quantity is not null").collect()}
    assert ordered and set(ordered) <= set(published)
    assert all(r.suggested_quantity % 4 == 0 and r.suggested_quantity >= published[i].quantity + 4 for i, r in ordered.items())
    # a later run replaces the one before; runs of other content, mapping or month do not join
    again = steps.next_steps(month, [MAPPING], report(), ledger, datetime(2026, 7, 2), settings, publishable=True)
    assert {r.finished for r in again["runs"].collect()} == {datetime(2026, 7, 2)}
    assert steps.runs_of(spark, ledger).count() == 2 and spark.read.parquet(ledger).count() == 4
    shuffled = steps.signature(rows.repartition(7), [MAPPING])
    assert shuffled == steps.signature(rows, [MAPPING])
    assert steps.signature(rows.filter("source_row_id <> 'r1-i07'").limit(100), [MAPPING])[0] != shuffled[0]
    assert steps.signature(rows, [Mapping(**{**MAPPING.__dict__, "quantity_unit": "box"})])[1] != shuffled[1]


def test_conflicting_orders_are_of_unknown_status(spark):
    rows = source(spark, [("1", "o1", "a", "A", "x", "2026-06-01", "1", "2", "EUR"), ("2", "o1", "b", "B", "y", "2026-06-01", "1", "2", "EUR"), ("3", "o2", "a", "A", "x", "2026-06-02", "1", "2", "EUR")])
    audit = spark.createDataFrame([("v1", "1", "order_conflict"), ("v1", "2", "order_conflict"), ("v1", "3", "duplicate_removed")], "version_id string, source_row_id string, reason string")
    got = steps.admitted(rows, audit).collect()
    assert sorted((r.source_row_id, r.record_status, "unknown_status" in r.issues) for r in got) == [("1", "unknown", True), ("2", "unknown", True)]
