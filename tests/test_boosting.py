"""Histogram boosting against a plain leaf-wise version, and the boosted method at every origin."""

import heapq
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopledger.operators import boosting, forecast

FEATURES = ["a", "b", "c"]


def plain_fit(x, y, cuts, s):
    """Trees as nested tuples, one leaf opened at a time from a heap; bins from the given cuts."""
    bins = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])
    raw, gains = np.full(len(y), y.mean()), []
    for _ in range(s.trees):
        g = raw - y

        def search(rows, g=g):
            best = None
            whole = g[rows].sum() ** 2 / (len(rows) + s.l2)
            for f in range(x.shape[1]):
                for c in range(len(cuts[f])):
                    left = rows[bins[rows, f] <= c]
                    right = rows[bins[rows, f] > c]
                    if min(len(left), len(right)) < s.leaf_rows:
                        continue
                    gain = g[left].sum() ** 2 / (len(left) + s.l2) + g[right].sum() ** 2 / (len(right) + s.l2) - whole
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, left, right)
            return best

        leaves, heap, order = [], [], 0
        waiting = [np.arange(len(y))]
        while True:
            for rows in waiting:
                found = search(rows)
                if found:
                    heapq.heappush(heap, (-found[0], order, rows, found))
                    order += 1
                else:
                    leaves.append(rows)
            if not heap or len(heap) + len(leaves) >= s.leaves:
                break
            gain, _, _, found = heapq.heappop(heap)
            gains.append(-gain)
            waiting = [found[1], found[2]]
        for rows in leaves + [h[2] for h in heap]:
            raw[rows] -= s.rate * g[rows].sum() / (len(rows) + s.l2)
    return raw, gains


def rows_of(n, seed):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.normal(size=n), draw.integers(0, 12, n), draw.exponential(size=n)]).round(3)
    return x, (np.sin(2 * x[:, 0]) + 0.2 * x[:, 1] + (x[:, 2] > 1) + draw.normal(scale=0.1, size=n)).round(4)


@pytest.mark.parametrize(("leaves", "local"), [(2, 0), (6, 200), (6, 10_000)])
def test_models_equal_a_plain_version(spark, leaves, local, monkeypatch):
    """All in passes, the larger ones in passes, and each by one task."""
    monkeypatch.setattr(boosting, "STORED", 3)
    monkeypatch.setattr(boosting, "LOCAL_ROWS", local)
    settings = boosting.Boosting(trees=7, leaves=leaves, leaf_rows=5, bins=32)
    data = {k: rows_of(150 + 40 * k, k) for k in range(3)}
    data[9] = rows_of(20, 9)  # too few
    table = [(k, *map(float, r), float(v)) for k, (x, y) in data.items() for r, v in zip(x, y, strict=True)]
    train = spark.createDataFrame([*table, (0, 1.0, 1.0, 1.0, None)], "k int, a double, b double, c double, y double").repartition(5).cache()
    models = boosting.fit(train, "k", FEATURES, "y", settings)
    assert sorted(models) == [0, 1, 2]
    for k, m in models.items():
        x, y = data[k]
        raw, gains = plain_fit(x, y, m.cuts, settings)
        assert len(m.trees) == 7 and np.allclose(m.predict(x), raw, atol=1e-9)
        assert sum((t.feature >= 0).sum() for t in m.trees) == len(gains)
        assert np.abs(raw - y).mean() < np.abs(y - y.mean()).mean()
    out = boosting.predicted(train, "k", FEATURES, models, "p").filter("y is not null").groupBy("k").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("e")).collect()
    assert sorted(r.k for r in out) == [0, 1, 2]
    for r in out:
        assert abs(r.e - np.abs(models[r.k].predict(data[r.k][0]) - data[r.k][1]).mean()) < 1e-9


def test_constant_rows_have_one_leaf(spark):
    train = spark.range(60).select(F.lit(1).alias("k"), F.lit(2.0).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(0.0).alias("c"), F.lit(3.0).alias("y"))
    models = boosting.fit(train, "k", FEATURES, "y", boosting.Boosting(trees=2))
    assert np.allclose(models[1].predict(np.array([[1.0, np.nan, 0.0]])), 3.0) and all(t.feature.max() < 0 for t in models[1].trees)
    assert boosting.fit(train.limit(0), "k", FEATURES, "y") == {}


def test_windows_end_before_their_origin(spark):
    first = date(2026, 1, 1)
    grid = spark.createDataFrame([(f"i{k}", t, first + timedelta(days=t), float((t * (k + 3)) % 11)) for k in range(3) for t in range(150)], "item_id string, t int, day date, quantity double")
    features = forecast.trailing_features(grid).cache()
    keys = grid.select("item_id").distinct()
    got = forecast.training_windows(features, keys, [100, 107, 140]).groupBy("origin").count().collect()
    want = {o: 3 * len(range(max(28, o - 180), o - 6, 7)) for o in (100, 107, 140)}
    assert {r.origin: r["count"] for r in got} == want
    assert forecast.boosted_forecasts(features, keys.limit(0), [100]) is None


def test_small_models_are_grown_once_and_apart(spark, tmp_path, monkeypatch):
    plain, log = boosting.grown, str(tmp_path / "grown")

    def noted(x, label, raw, settings):
        from pyspark import TaskContext

        with open(log, "a") as f:
            f.write(f"{TaskContext.get().partitionId()}\n")
        yield from plain(x, label, raw, settings)

    monkeypatch.setattr(boosting, "grown", noted)
    table = [(k, *map(float, r), float(v)) for k in range(12) for r, v in zip(*rows_of(60, k), strict=True)]
    models = boosting.fit(spark.createDataFrame(table, "k int, a double, b double, c double, y double"), "k", FEATURES, "y", boosting.Boosting(trees=2, leaves=3))
    tasks = open(log).read().split()
    assert len(tasks) == len(models) == 12 and len(set(tasks)) > 3
    assert all(len(m.trees) == 2 for m in models.values())
