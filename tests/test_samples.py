"""Samples, start centres and resampling against plain versions over all rows."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from shopledger.config import Analysis
from shopledger.functions import draws
from shopledger.operators import anomaly, baskets, customers


def test_each_tree_takes_the_first_of_all_rows(spark):
    rows = spark.range(4000).select(F.concat(F.lit("k"), F.col("id") % 3990).alias("item"), (F.col("id") % 97).cast("double").alias("v0"), F.sin("id").alias("v1")).repartition(7).cache()
    sent = anomaly.tree_samples(rows, ["v0", "v1"], ["item"], 5, 64, 42)
    assert sent.groupBy("tree").count().filter("count > 64 * 7").isEmpty()
    parts = sent.toPandas()
    all_ = rows.select(F.xxhash64("item", F.lit(42)).alias("h"), "v0", "v1").toPandas()
    for tree in range(5):
        place = anomaly.tree_hashes(all_["h"].to_numpy().view(np.uint64), tree)
        order = np.lexsort([all_["v1"], all_["v0"], place])[:64]
        assert np.array_equal(anomaly.own_rows(parts[parts["tree"] == tree], ["v0", "v1"], 64), all_[["v0", "v1"]].to_numpy()[order])
    forest = anomaly.iso_fit(rows, ["v0", "v1"], ["item"], 5, 64)
    again = anomaly.iso_fit(rows.coalesce(2), ["v0", "v1"], ["item"], 5, 64)
    assert forest.sample == 64 and np.array_equal(forest.threshold, again.threshold) and np.array_equal(forest.path, again.path)
    few = anomaly.iso_fit(rows.filter("v0 < 1"), ["v0", "v1"], ["item"], 3, 64)
    assert few.sample == rows.filter("v0 < 1").count()


def plain_kmeans(x, k, rng):
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        gap = np.min(((x[:, None] - np.array(centres)) ** 2).sum(2), axis=1)
        centres.append(x[rng.choice(len(x), p=gap / gap.sum())])
    centres = np.array(centres)
    for _ in range(300):
        label = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        moved = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_start_centres_see_all_points(spark):
    rng = np.random.default_rng(1)
    # a far group of 12 points among 6000, which a sample of 2,000 would show four times
    x = np.concatenate([rng.normal([0, 0], 0.3, (4000, 2)), rng.normal([4, 0], 0.3, (1988, 2)), rng.normal([40, 40], 0.2, (12, 2))])
    points = spark.createDataFrame([(customers.FULL, str(i), *map(float, r)) for i, r in enumerate(x)], "grp int, id string, a double, b double").repartition(5).cache()
    centres, cost, rested = customers.kmeans_many(points, "id", ["a", "b"], [2, 3, 5], 4, 42)
    for k in (2, 3, 5):
        best = min(plain_kmeans(x, k, rng) for _ in range(4))
        assert cost[customers.FULL, k] <= 1.05 * best and rested[customers.FULL, k]
    assert any(np.linalg.norm(c - 40) < 1 for c in centres[customers.FULL, 3])
    stopped = customers.kmeans_many(points, "id", ["a", "b"], [5], 1, 42, iterations=1)[2]
    assert not stopped[customers.FULL, 5]


def test_equal_points_and_small_groups(spark):
    points = spark.createDataFrame([(g, str(i), 1.0, 2.0) for g in (customers.FULL, 0) for i in range(4)] + [(1, "x", 0.0, 0.0)], "grp int, id string, a double, b double")
    centres, cost, _ = customers.kmeans_many(points, "id", ["a", "b"], [2], 2, 1)
    assert set(centres) == {(customers.FULL, 2), (0, 2)} and all(v == 0 for v in cost.values())


def test_item_clusters_are_never_published(spark):
    rng = np.random.default_rng(3)
    rows = [(f"i{i}", float(np.exp(1 + 6 * (i % 2))), 0.5 + (i % 2), 0.2 + 0.5 * (i % 2), 0.1, 30 + int(rng.integers(3))) for i in range(80)]
    items = spark.createDataFrame(rows, "item_id string, amount double, weekly_cv double, nonzero_day_share double, change double, observed_days int")
    found = customers.item_clusters(items, Analysis(k_max=3))[0].collect()
    assert any(r.numeric_gate for r in found) and not any(r.publishable for r in found) and all(r.converged is not None for r in found)


def test_resampling_equals_a_plain_version(spark):
    rows = [(f"c{i % 37}" if i % 50 else None, i % 2, (i // 3) % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "customer_id string, hit int, popular_hit int").repartition(6)
    got = baskets.bootstrap(df, "customer_id", draws=40).first()
    blocks = {}
    for c, h, p in rows:
        d, n = blocks.get(c, (0, 0))
        blocks[c] = d + h - p, n + 1
    estimates = []
    for k in range(40):
        top = low = 0
        for c, (d, n) in blocks.items():
            u = int(hashlib.md5(f"{c or ''}:{k // 4}:1042".encode()).hexdigest()[8 * (k % 4) :][:8], 16) / 2**32
            w, below, term = 0, math.exp(-1), math.exp(-1)
            while u >= below and w < 12:
                w += 1
                term /= w
                below += term
            top, low = top + w * d, low + w * n
        estimates.append(top / low)
    assert got.blocks == len(blocks) == 38
    assert np.allclose([got.lower, got.upper], np.percentile(estimates, [2.5, 97.5]))
    assert baskets.bootstrap(df.filter("customer_id = 'c1'"), "customer_id", draws=8).first().lower is None
    plan = baskets.bootstrap(df, "customer_id", draws=40)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_draws_are_digits_of_md5(spark):
    got = spark.createDataFrame([("a", 7), (None, 8)], "x string, y int").select(draws.draw("x", "y", seed=3).alias("d")).collect()
    assert [r.d for r in got] == [int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in ("a:7:3", "8:3")]
    assert abs(np.mean([draws.poisson_weights(str(i), 50, 1).mean() for i in range(200)]) - 1) < 0.05


def test_popular_lists_and_triples_do_not_need_broadcasts(spark, monkeypatch):
    pairs = spark.createDataFrame([(f"o{o}", f"i{i:02}") for o in range(60) for i in range(12) if (o * i + o + i) % 3], "order_id string, item_id string").cache()
    popular, settings = baskets.popularity(pairs), Analysis(min_support=0.05, min_count=3)
    lists = sorted(map(tuple, baskets.popular_for(pairs, popular).collect()))
    sets = sorted((tuple(r["items"]), r.n) for r in baskets.itemsets(pairs, 60, settings).collect())
    monkeypatch.setattr(baskets, "SHIPPED_RANKS", 0)
    monkeypatch.setattr(baskets, "SHIPPED_PAIRS", 0)
    assert sorted(map(tuple, baskets.popular_for(pairs, popular).collect())) == lists
    assert sorted((tuple(r["items"]), r.n) for r in baskets.itemsets(pairs, 60, settings).collect()) == sets
    held = {}
    for r in pairs.collect():
        held.setdefault(r.order_id, set()).add(r.item_id)
    counts = {s: sum(set(s) <= b for b in held.values()) for s, _ in sets}
    assert counts == dict(sets) and any(len(s) == 3 for s in counts)
    ranks = {r.item_id: -r.orders for r in popular.collect()}
    for o, b in held.items():
        want = sorted((i for i in ranks if i not in b), key=lambda i: (ranks[i], i))[:5]
        assert [i for x, i, _ in sorted(lists, key=lambda t: t[2]) if x == o] == want
