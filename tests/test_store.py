"""Sources that arrive late or again: only their months are rebuilt, and the result is that of a full run."""

import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shopledger.config import FIELDS, Mapping, Report
from shopledger.operators import normalize, sales
from shopledger.plans import store
from shopledger.sources.readers import canonicalize

MAPPED = {f: f if f in ("order_id", "item_id", "item_name", "customer_id", "event_time", "quantity", "line_amount", "currency") else None for f in FIELDS}
MAPPING = Mapping(columns=MAPPED, time_format="%Y-%m-%d", timezone="UTC")
REPORT = Report(month="2026-06", merge_mode="replace_overlap", duplicates="drop_exact", coverage_start=date(2026, 1, 1), coverage_end=date(2026, 6, 30), complete_coverage=True)


def source(spark, name, number, first, last, step=1, extra=()):
    rows, day, k = [], first, 0
    while day <= last:
        for j in range(3):
            k += 1
            rows.append((f"{name}-{k}", f"o{day:%m%d}-{j}", f"i{(k + j) % 5}", "Item", f"c{j}", day.isoformat(), str(1 + (k * number) % 7), f"{k % 9}.25", "EUR"))
        day += timedelta(days=step)
    columns = "source_row_id order_id item_id item_name customer_id event_time quantity line_amount currency".split()
    raw = spark.createDataFrame([*rows, *extra], ", ".join(f"{c} string" for c in columns))
    return normalize.normalize(canonicalize(raw, MAPPING), MAPPING).withColumns({"version_id": F.lit(name), "source_no": F.lit(number)})


def whole(*parts):
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return sorted(map(tuple, sales.daily_fact(sales.label(rows, MAPPING, REPORT), MAPPING).collect()))


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{folder}/daily") for f in names if f.endswith(".parquet")}


def months_of(paths):
    return {p.split("month=")[1].split("/")[0] for p in paths}


def test_late_sources_rebuild_their_months_only(spark, tmp_path):
    folder = str(tmp_path / "store")
    # an order whose rows lie in March and in May disagrees on its day; a row has no day
    odd = [("x1", "wide", "i1", "Item", "c1", "2026-03-05", "2", "3", "EUR"), ("x2", "wide", "i1", "Item", "c1", "2026-05-09", "2", "3", "EUR"), ("x3", "late", "i2", "Item", "c2", "soon", "1", "1", "EUR")]
    first = source(spark, "a", 1, date(2026, 1, 1), date(2026, 5, 31), extra=odd)
    assert store.add_source(folder, first, MAPPING, REPORT) == ["2026-01", "2026-02", "2026-03", "2026-04", "2026-05", "unknown"]
    assert sorted(map(tuple, store.daily(spark, folder).collect())) == whole(first)
    before = files(folder)
    second = source(spark, "b", 2, date(2026, 5, 20), date(2026, 6, 30), step=2)
    assert store.add_source(folder, second, MAPPING, REPORT) == ["2026-05", "2026-06"]
    assert sorted(map(tuple, store.daily(spark, folder).collect())) == whole(first, second)
    kept = before & files(folder)
    assert months_of(kept) == {"2026-01", "2026-02", "2026-03", "2026-04"} and months_of(before - kept) == {"2026-05"}
    # a file for February that comes last but counts as older than the second source
    third = source(spark, "c", 3, date(2026, 2, 3), date(2026, 2, 20))
    before = files(folder)
    assert store.add_source(folder, third, MAPPING, REPORT) == ["2026-02"]
    assert sorted(map(tuple, store.daily(spark, folder).collect())) == whole(first, second, third)
    assert months_of(before - files(folder)) == {"2026-02"}
    # the second source again, shorter and with other numbers: its old months are rebuilt too
    again = source(spark, "b", 2, date(2026, 6, 10), date(2026, 6, 30))
    assert store.add_source(folder, again, MAPPING, REPORT) == ["2026-05", "2026-06"]
    assert sorted(map(tuple, store.daily(spark, folder).collect())) == whole(first, again, third)
    assert store.sources(spark, folder).count() == 3 and spark.read.parquet(f"{folder}/ledger").count() == 4


def test_one_source_at_a_time(spark, tmp_path):
    a, b = source(spark, "a", 1, date(2026, 1, 1), date(2026, 1, 2)), source(spark, "b", 1, date(2026, 1, 1), date(2026, 1, 2))
    with pytest.raises(ValueError, match="one source"):
        store.add_source(str(tmp_path / "s"), a.unionByName(b), MAPPING, REPORT)
    store.add_source(str(tmp_path / "s"), a, MAPPING, REPORT)
    with pytest.raises(ValueError, match="numbers"):
        store.add_source(str(tmp_path / "s"), b, MAPPING, REPORT)


def test_months_between():
    assert store.months_between(date(2025, 11, 30), date(2026, 2, 1)) == {"2025-11", "2025-12", "2026-01", "2026-02"}
    assert store.months_between(None, None) == set()
