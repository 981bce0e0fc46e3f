"""Unusual sales days: same-weekday reference, robust thresholds and an isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Report

VECTOR = ("v0", "v1", "v2")
LEGACY_VECTOR = ("l0", "l1", "l2")


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    place = lambda half: F.greatest(half.cast("int"), F.lit(1))
    low = F.try_element_at(ordered, place(F.floor((n + 1) / 2)))
    high = F.try_element_at(ordered, place(F.ceil((n + 1) / 2)))
    return (low + high) / 2


def weekday_ref(grid: DataFrame, report: Report) -> DataFrame:
    """Median and MAD of the same weekday over the previous 84 days, from at least six known open days."""
    closed = F.col("day").isin(*report.closed_dates) if report.closed_dates else F.lit(False)
    usable = F.when(~closed, F.col("quantity"))
    frame = Window.partitionBy("item_id", F.weekday("day")).orderBy("t").rangeBetween(-84, -1)  # at most 12 days
    seen = grid.withColumn("_seen", F.collect_list(usable).over(frame)).withColumn("closed", closed)
    enough = F.size("_seen") >= 6
    centred = seen.withColumn("reference", F.when(enough, _median(F.col("_seen"))))
    off = F.transform("_seen", lambda v: F.abs(v - F.col("reference")))
    return centred.withColumn("mad", F.when(enough, _median(off))).drop("_seen")


def measured_days(grid: DataFrame, report: Report) -> DataFrame:
    """Every item day with its reference, its past spread and both model vectors."""
    by_day = Window.partitionBy("item_id").orderBy("t")
    back = lambda n: by_day.rowsBetween(-n, -1)
    q = F.col("quantity")
    cutoff = F.col("day") < F.lit(report.month_start)
    base = weekday_ref(grid, report).withColumns({
        "_rows28": F.count(F.lit(1)).over(back(28)),
        "_known28": F.count(q).over(back(28)),
        "_mean28": F.avg(q).over(back(28)),
        "_std28": F.stddev_pop(q).over(back(28)),
        "_mean7": F.avg(q).over(back(7)),
        "_known7": F.count(q).over(back(7)),
        "_past28": F.collect_list("quantity").over(back(28)),
        "_sold_before": F.count_if(q > 0).over(by_day.rowsBetween(Window.unboundedPreceding, -1)),
        "_sold_history": F.count_if(cutoff & (q > 0)).over(Window.partitionBy("item_id")),
    })
    scale = F.greatest(F.col("reference"), F.col("_mean28"), F.lit(1.0))
    old_scale = F.greatest(F.col("_mean28"), F.lit(1.0))
    diff = q - F.col("reference")
    threshold = F.greatest(F.lit(3.0), 0.7 * scale, F.lit(3 * 1.4826) * F.col("mad"))
    whole = (F.col("_known28") == F.col("_rows28")) & q.isNotNull() & ~F.col("closed")
    return base.select(
        "item_id", "t", "day", F.col("quantity").alias("actual"), "reference", "mad",
        diff.alias("difference"), threshold.alias("threshold"),
        (whole & F.col("reference").isNotNull() & (F.col("_rows28") == 28) & (F.col("_sold_before") >= 8)).alias("probe_ok"),
        (whole & (F.col("_sold_history") >= 8)).alias("legacy_ok"),
        (F.abs(diff) > threshold).alias("simple_rule"),
        (F.abs(q - _median(F.col("_past28"))) > F.greatest(F.lit(3.0), 0.7 * old_scale)).alias("legacy_substantial"),
        (diff / scale).alias("v0"),
        (F.abs(diff) / F.greatest(F.lit(1.0), F.col("mad") * 1.4826)).alias("v1"),
        (F.col("_std28") / scale).alias("v2"),
        (q / old_scale).alias("l0"),
        (F.col("_mean7") / old_scale).alias("l1"),
        (F.col("_std28") / old_scale).alias("l2"),
    )


def training_days(measured: DataFrame, report: Report, legacy: bool = False) -> DataFrame:
    """Days before the month that a model may learn from: the last 90, from day 42 (14) on."""
    cutoff = (report.month_start - report.calendar_range[0]).days
    start = max(14 if legacy else 42, cutoff - 90)
    ok = F.col("legacy_ok") if legacy else F.col("probe_ok")
    return measured.filter(ok & (F.col("t") >= start) & (F.col("t") < cutoff))


def probe_days(measured: DataFrame, report: Report) -> DataFrame:
    """The month's days that can be judged."""
    first = (report.month_start - report.calendar_range[0]).days
    start = max(42, first - 90, first)
    return measured.filter(F.col("probe_ok") & (F.col("t") >= start) & (F.col("day") <= F.lit(report.month_end)))


@dataclass(frozen=True)
class Forest:
    """Isolation trees as complete binary heaps: split feature (-1 for a leaf), threshold, path length."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    sample: int


def average_path(n: float) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(rows: np.ndarray, depth: int, rng: np.random.Generator):
    size = 2 ** (depth + 1) - 1
    feature, threshold, path = np.full(size, -1, np.int32), np.zeros(size), np.zeros(size)
    waiting = [(0, rows, 0)]
    while waiting:
        node, part, level = waiting.pop()
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else []
        if level == depth or len(part) <= 1 or len(spread) == 0:
            path[node] = level + average_path(len(part))
            continue
        f = int(rng.choice(spread))
        cut = rng.uniform(part[:, f].min(), part[:, f].max())
        feature[node], threshold[node] = f, cut
        left = part[:, f] <= cut
        waiting += [(2 * node + 1, part[left], level + 1), (2 * node + 2, part[~left], level + 1)]
    return feature, threshold, path


def tree_hashes(base: np.ndarray, tree: int) -> np.ndarray:
    """Rows' places in the order of a tree, from the hashes of their keys."""
    h = base + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tree_samples(train: DataFrame, columns: Sequence[str], key: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """tree, place and columns: per task and tree the ``sample`` rows that come first in the tree's own order of all rows.

    A task keeps trees · sample rows at most, whatever it reads, and the first of all rows are among the first of their tasks.
    """
    width = len(columns)

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [np.empty((0, width))] * trees
        places = [np.empty(0, np.uint64)] * trees
        for batch in batches:
            base = batch["_h"].to_numpy().view(np.uint64)
            x = batch[list(columns)].to_numpy(dtype=float)
            for tree in range(trees):
                h = tree_hashes(base, tree)
                if len(places[tree]) == sample:
                    ahead = h <= places[tree][-1]
                    h, rows = h[ahead], x[ahead]
                else:
                    rows = x
                if not len(h):
                    continue
                h, rows = np.concatenate([places[tree], h]), np.concatenate([kept[tree], rows])
                first = np.lexsort([*rows.T[::-1], h])[:sample]
                places[tree], kept[tree] = h[first], rows[first]
        yield pd.DataFrame({
            "tree": np.repeat(np.arange(trees), [len(p) for p in places]), "place": np.concatenate(places).view(np.int64),
            **{c: np.concatenate([k[:, i] for k in kept]) for i, c in enumerate(columns)},
        })

    hashed = train.select(F.xxhash64(*key, F.lit(seed)).alias("_h"), *[F.col(c).cast("double").alias(c) for c in columns])
    return hashed.mapInPandas(smallest, "tree long, place long, " + ", ".join(f"{c} double" for c in columns))


def own_rows(part: pd.DataFrame, columns: Sequence[str], sample: int) -> np.ndarray:
    """The rows of a tree, merged from all tasks."""
    x, places = part[list(columns)].to_numpy(dtype=float), part["place"].to_numpy().view(np.uint64)
    return x[np.lexsort([*x.T[::-1], places])[:sample]]


def iso_fit(train: DataFrame, columns: Sequence[str], key: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> Forest:
    """Grow isolation trees in the cluster, each from a sample of its own over all training rows.

    A tree's sample are the rows with its smallest hashes. One aggregation finds those of all trees: tasks hand over what comes first among
    their rows, and a tree's task merges and grows. The driver receives the trees.
    """
    depth = max(1, math.ceil(math.log2(max(sample, 2))))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree, rows = int(part["tree"].iloc[0]), own_rows(part, columns, sample)
        deep = max(1, math.ceil(math.log2(max(len(rows), 2))))
        feature, threshold, path = _grow(rows, deep, np.random.default_rng([seed, tree]))
        room = 2 ** (depth + 1) - 1 - len(feature)
        grown = [np.concatenate([a, np.full(room, v, a.dtype)]).tolist() for a, v in ((feature, -1), (threshold, 0), (path, 0))]
        return pd.DataFrame([(tree, len(rows), *grown)], columns=["tree", "n", "feature", "threshold", "path"])

    grown = (
        tree_samples(train, columns, key, trees, sample, seed).groupBy("tree")
        .applyInPandas(grow, "tree long, n long, feature array<int>, threshold array<double>, path array<double>")
        .toPandas().sort_values("tree")
    )
    return Forest(*[np.stack(grown[c].to_list()) for c in ("feature", "threshold", "path")], int(grown["n"].iloc[0]))


def iso_score(forest: Forest, df: DataFrame, columns: Sequence[str], name: str = "score") -> DataFrame:
    """Anomaly score in [-1, 0); below -0.6 is unusual."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        model = shared.value
        x = np.column_stack([s.to_numpy(dtype=float) for s in series])
        total = np.zeros(len(x))
        for feature, threshold, path in zip(model.feature, model.threshold, model.path, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(math.log2(len(feature) + 1))):
                f = feature[node]
                inner = f >= 0
                go_left = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[node]
                node = np.where(inner, 2 * node + np.where(go_left, 1, 2), node)
            total += path[node]
        return pd.Series(-(2.0 ** (-(total / len(model.feature)) / average_path(model.sample))))

    return df.withColumn(name, score(*[F.col(c) for c in columns]))


def anomalies(measured: DataFrame, report: Report, trees: int = 100, min_train: int = 200) -> DataFrame:
    """Days that break the simple rule and are confirmed by the forest or extreme by themselves."""
    train, legacy = training_days(measured, report), training_days(measured, report, legacy=True)
    probes = probe_days(measured, report)
    if train.limit(min_train).count() < min_train:
        return _flagged(probes.filter(F.lit(False)).withColumns({"score": F.lit(0.0), "residual_score": F.lit(0.0)}))
    key = ["item_id", "t"]
    scored = iso_score(iso_fit(legacy, LEGACY_VECTOR, key, trees), probes, LEGACY_VECTOR, "score")
    scored = iso_score(iso_fit(train, VECTOR, key, trees), scored, VECTOR, "residual_score")
    confirmed = (F.col("score") < -0.60) & F.col("legacy_substantial")
    extreme = F.abs(F.round("difference", 3)) > F.greatest(F.lit(10.0), 3 * F.col("threshold"))
    return _flagged(scored.filter(F.col("simple_rule") & (confirmed | extreme)))


def _flagged(rows: DataFrame) -> DataFrame:
    return rows.select(
        "item_id", F.col("day").alias("date"), "actual",
        F.round("reference", 3).alias("reference"), F.round("difference", 3).alias("difference"),
        (F.abs(F.round("difference", 3)) / F.col("threshold")).alias("strength"),
        F.round("score", 4).alias("score"), F.round("residual_score", 4).alias("residual_score"),
    )


def rule_anomalies(measured: DataFrame, report: Report) -> DataFrame:
    """The part that needs no model: the simple rule and the extreme rule per judged day."""
    probes = probe_days(measured, report)
    extreme = F.abs(F.round("difference", 3)) > F.greatest(F.lit(10.0), 3 * F.col("threshold"))
    return probes.filter("simple_rule").select(
        "item_id", F.col("day").alias("date"), "actual",
        F.round("reference", 3).alias("reference"), F.round("difference", 3).alias("difference"),
        (F.abs(F.round("difference", 3)) / F.col("threshold")).alias("strength"), extreme.alias("extreme"),
    )


def anomaly_status(items: DataFrame, probes: DataFrame, found: DataFrame, monthly: bool = False) -> DataFrame:
    """monthly_summary, insufficient, clear or detected per item, with the number of judged days."""
    checked = probes.groupBy("item_id").agg(F.count(F.lit(1)).alias("tested_days"))
    hits = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("anomaly_days"))
    joined = items.select("item_id").join(checked, "item_id", "left").join(hits, "item_id", "left")
    status = (
        F.when(F.lit(monthly), "monthly_summary")
        .when(F.col("tested_days").isNull(), "insufficient")
        .when(F.col("anomaly_days") > 0, "detected")
        .otherwise("clear")
    )
    zero = F.lit(0)
    return joined.select(
        "item_id", status.alias("status"),
        F.coalesce("tested_days", zero).alias("tested_days"), F.coalesce("anomaly_days", zero).alias("anomaly_days"),
    )


def v2_rule(grid: DataFrame, report: Report) -> DataFrame:
    """The older rule: distance from the 28-day median against three MADs and 0.7 of the mean."""
    cutoff = (report.month_start - report.calendar_range[0]).days
    by_day = Window.partitionBy("item_id").orderBy("t")
    q = F.col("quantity")
    closed = F.col("day").isin(*report.closed_dates) if report.closed_dates else F.lit(False)
    base = grid.withColumns({
        "_past": F.collect_list("quantity").over(by_day.rowsBetween(-28, -1)),
        "_mean": F.avg(q).over(by_day.rowsBetween(-28, -1)),
        "_history": F.count_if((F.col("t") < cutoff) & (q != 0)).over(Window.partitionBy("item_id")),
    })
    base = base.filter((F.col("_history") >= 8) & (F.col("t") >= max(14, cutoff)) & ~closed & q.isNotNull())
    base = base.withColumn("reference", _median(F.col("_past")))
    mad = _median(F.transform("_past", lambda v: F.abs(v - F.col("reference"))))
    diff = q - F.col("reference")
    return base.select(
        "item_id", F.col("day").alias("date"), q.alias("actual"), F.round("reference", 3).alias("reference"),
        F.round(diff, 3).alias("difference"),
        (F.abs(diff) > F.greatest(F.lit(3.0), 3 * mad)).alias("simple_rule"),
        (F.abs(F.round(diff, 3)) > F.greatest(F.lit(3.0), 0.7 * F.greatest(F.col("_mean"), F.lit(1.0)))).alias("substantial"),
    )
