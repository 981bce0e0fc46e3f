"""Customers: recency/frequency/amount features, groups that pass the publication gates, follow-ups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Analysis
from ..functions.draws import draw
from ..functions.money import PRODUCT
from ..functions.spread import exact_quantiles
from ..sources.stage import staged

SILHOUETTE_SAMPLE = 2000
SUBSAMPLES = 5
#: Rounds that draw start centres from all points, and candidates a round as a multiple of the largest k.
ROUNDS, OVERSAMPLING = 3, 2
CANDIDATES = "k int, cluster_count long, min_cluster_size long, silhouette double, ari_median double, publishable boolean, converged boolean"
FULL = -1  # group number of the whole customer table


def rfm_features(orders: DataFrame, kind: str = "rfm", date_end: date | None = None) -> DataFrame:
    """Recency in whole days to the day after the last observed UTC day, distinct orders, exact amount."""
    if date_end is not None:
        reference = F.date_add(F.lit(date_end), 1)
        dated = orders.withColumn("_ref", reference)
    else:
        last = orders.agg(F.date_add(F.to_date(F.max("event_time")), 1).alias("_ref")).withColumn("_k", F.lit(1))
        dated = orders.withColumn("_k", F.lit(1)).join(F.broadcast(last), "_k")
    seconds = F.unix_timestamp(F.max("_ref").cast("timestamp")) - F.unix_timestamp(F.max("event_time"))
    # Orders are distinct before they are counted, so a very frequent customer stays map-side combinable.
    per_order = dated.groupBy("customer_id", "order_id").agg(
        F.max("event_time").alias("event_time"), F.max("_ref").alias("_ref"),
        F.sum(F.col("amount").cast(PRODUCT)).alias("amount"),
    )
    features = per_order.groupBy("customer_id").agg(
        F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("long").alias("recency_days"),
        F.count(F.lit(1)).alias("frequency"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(PRODUCT).alias("monetary"),
    )
    return features if kind == "rfm" else features.drop("monetary")


def robust_scale(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """log1p, then (x - median) / IQR with exact quantiles; a zero IQR scales by one."""
    logged = df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in columns})
    keys = list(groups) or ["_k"]
    logged = logged if groups else logged.withColumn("_k", F.lit(1))
    scaled = logged
    for c in columns:  # every statistic reads the same unscaled table
        stats = exact_quantiles(logged, c, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, keys)
        spread = F.col("_q3") - F.col("_q1")
        scaled = scaled.join(F.broadcast(stats), keys).withColumn(
            c, (F.col(c) - F.col("_q2")) / F.when(spread == 0, 1.0).otherwise(spread)
        ).drop("_q1", "_q2", "_q3")
    return scaled.drop("_k")


def _sample_groups(features: DataFrame, key: str, seed: int) -> DataFrame:
    """The whole table as group -1 and five hashed 80 % subsamples."""
    bucket = lambda j: F.pmod(F.xxhash64(key, F.lit(seed + 100 + j)), F.lit(10))
    groups = F.array_compact(F.array(F.lit(FULL), *[F.when(bucket(j) < 8, F.lit(j)) for j in range(SUBSAMPLES)]))
    return features.withColumn("grp", F.explode(groups))


def _seed_centres(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted points, each drawn in proportion to its weighted square distance from those before."""
    centres = [points[rng.choice(len(points), p=weights / weights.sum())]]
    for _ in range(k - 1):
        gap = weights * np.min(((points[:, None, :] - np.array(centres)[None]) ** 2).sum(2), axis=1)
        total = gap.sum()
        centres.append(points[rng.choice(len(points), p=gap / total) if total > 0 else rng.integers(len(points))])
    return np.array(centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each point's nearest centre, the first of equal ones, and the square distance: one centre at a time, column by column."""
    columns = np.ascontiguousarray(x.T)
    label, least = np.zeros(len(x), np.int64), None
    for number, centre in enumerate(centres):
        distance = np.zeros(len(x))
        for column, value in zip(columns, centre, strict=True):
            gap = column - value
            gap *= gap
            distance += gap
        if least is None:
            least = distance
        else:
            label[distance < least] = number
            np.minimum(least, distance, out=least)
    return label, least


def _spread(h: np.ndarray, number: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row hashes, others for every number."""
    h = h + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _passes(points: DataFrame, key: str, columns: Sequence[str], seed: int, run, schema: str) -> DataFrame:
    """``run(grp, hashes, x)`` over the points in batches of one group; it yields rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("grp"):
                rows = list(run(int(g), part["_h"].to_numpy().view(np.uint64), part[list(columns)].to_numpy(dtype=float)))
                yield pd.DataFrame(rows, columns=names)

    return points.select("grp", F.xxhash64(key, F.lit(seed)).alias("_h"), *columns).mapInPandas(each, schema)


def _start_models(points: DataFrame, key: str, columns: Sequence[str], ks: Sequence[int], restarts: int, seed: int) -> dict[tuple, np.ndarray]:
    """Start centres of every (group, k, restart), drawn from all points in a few passes.

    Each (group, restart) begins with one point; then every round each point joins its candidates with a chance of OVERSAMPLING · max(ks) times
    its share of the square distances, so a round adds about that many, wherever the points lie. The candidates are weighted by
    the points nearest to them and every k picks and settles its centres among them. Candidates do not grow with the points.
    """
    spark, width = points.sparkSession, len(columns)
    cells = ", ".join(f"s{i} double" for i in range(width))
    order = lambda r: F.struct(F.xxhash64(key, F.lit(seed), F.lit(r)).alias("h"), *columns)
    firsts = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.min(order(r)).alias(f"r{r}") for r in range(restarts)]).collect()
    sizes = {r["grp"]: r["n"] for r in firsts}
    chosen = {(f["grp"], r): np.array([f[f"r{r}"][1:]], float) for f in firsts for r in range(restarts)}
    wanted = OVERSAMPLING * max(ks)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(chosen)

        def costs(g, h, x, shared=shared):
            for r in range(restarts):
                yield g, r, float(_nearest(x, shared.value[g, r])[1].sum())

        total = {(r["grp"], r["restart"]): r["cost"] for r in _passes(points, key, columns, seed, costs, "grp int, restart int, cost double").groupBy("grp", "restart").agg(F.sum("cost").alias("cost")).collect()}

        def drawn(g, h, x, shared=shared, total=total, turn=turn):
            for r in range(restarts):
                if total[g, r] > 0:
                    chance = wanted * _nearest(x, shared.value[g, r])[1] / total[g, r]
                    for row in x[_spread(h, turn * restarts + r) < chance]:
                        yield g, r, *row.tolist()

        for row in _passes(points, key, columns, seed, drawn, f"grp int, restart int, {cells}").distinct().orderBy("grp", "restart", *[f"s{i}" for i in range(width)]).collect():
            chosen[row[0], row[1]] = np.vstack([chosen[row[0], row[1]], row[2:]])
    shared = spark.sparkContext.broadcast(chosen)

    def weights(g, h, x):
        for r in range(restarts):
            near, n = np.unique(_nearest(x, shared.value[g, r])[0], return_counts=True)
            for c, k in zip(near.tolist(), n.tolist(), strict=True):
                yield g, r, c, k

    weight = {k: np.zeros(len(c)) for k, c in chosen.items()}
    for row in _passes(points, key, columns, seed, weights, "grp int, restart int, place int, n long").groupBy("grp", "restart", "place").agg(F.sum("n").alias("n")).collect():
        weight[row[0], row[1]][row[2]] = row[3]
    names = [(g, k, r) for g in sorted(sizes) for k in ks for r in range(restarts) if sizes[g] >= k]
    weighted = spark.sparkContext.broadcast(weight)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for number in batch["id"]:
                g, k, r = names[number]
                x, w = shared.value[g, r], weighted.value[g, r]
                centres = _seed_centres(x, w, k, np.random.default_rng([seed, g + 1, k, r]))
                for _ in range(100):
                    member = (_nearest(x, centres)[0][:, None] == np.arange(k)) * w[:, None]
                    size = member.sum(0)
                    moved = np.where(size[:, None] > 0, (member.T @ x) / np.maximum(size, 1)[:, None], centres)
                    done, centres = ((moved - centres) ** 2).sum() <= 1e-6, moved
                    if done:
                        break
                rows.append((int(number), centres.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["id", "centres"])

    started = spark.range(0, len(names), 1, min(len(names), 64)).mapInPandas(start, "id long, centres array<double>")
    return {names[r["id"]]: np.array(r["centres"]).reshape(names[r["id"]][1], -1) for r in started.collect()}


def kmeans_many(points: DataFrame, key: str, columns: Sequence[str], ks: Sequence[int], restarts: int, seed: int, iterations: int = 300) -> tuple[dict, dict, dict]:
    """Fit every (group, k, restart) at once and keep the tightest restart of each (group, k).

    One pass per iteration serves all models that still move: tasks return only sums per (model, cluster), so the
    shuffle and the driver see at most models · k rows. ``points``: (grp, key, columns). Returns centres, cost and
    whether the model came to rest within ``iterations``, per (group, k).
    """
    models = _start_models(points, key, columns, ks, restarts, seed)
    names = sorted(models)
    width = len(columns)
    spark = points.sparkSession
    active, cost = set(names), {}
    schema = "model int, cluster int, n long, cost double, " + ", ".join(f"s{i} double" for i in range(width))
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast([(names.index(m), m[0], models[m]) for m in names if m in active])

        def partial(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for g, part in batch.groupby("grp"):
                    x = part[list(columns)].to_numpy(dtype=float)
                    for number, group, centres in shared.value:
                        if group != g:
                            continue
                        label, gap = _nearest(x, centres)
                        member = (np.arange(len(centres))[:, None] == label).astype(float)
                        sums = member @ np.column_stack([np.ones(len(x)), gap, x])
                        totals[number] = totals.get(number, 0) + sums
            yield pd.DataFrame(
                [(m, c, int(v[0]), *v[1:]) for m, rows in totals.items() for c, v in enumerate(rows)],
                columns=["model", "cluster", "n", "cost", *[f"s{i}" for i in range(width)]],
            )

        sums = points.select("grp", *columns).mapInPandas(partial, schema).groupBy("model", "cluster").agg(
            F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
        ).toPandas()
        for number, part in sums.groupby("model"):
            name = names[number]
            cost[name] = part["cost"].sum()
            moved = models[name].copy()
            filled = part[part["n"] > 0]
            moved[filled["cluster"]] = filled[[f"s{i}" for i in range(width)]].to_numpy() / filled[["n"]].to_numpy()
            if ((moved - models[name]) ** 2).sum() <= 1e-4:  # on features of about unit spread
                active.discard(name)
            models[name] = moved
        if not active:
            break
    best = {}
    for g, k, r in names:
        if (g, k) not in best or cost[g, k, r] < cost[g, k, best[g, k]]:
            best[g, k] = r
    kept = {m: (*m, r) for m, r in best.items()}
    return {m: models[n] for m, n in kept.items()}, {m: cost[n] for m, n in kept.items()}, {m: n not in active for m, n in kept.items()}


def assign(points: DataFrame, key: str, columns: Sequence[str], centres: dict) -> DataFrame:
    """(grp, key, k, cluster) under each group's models."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("grp"):
                x = part[list(columns)].to_numpy(dtype=float)
                for (group, k), own in shared.value.items():
                    if group == g:
                        yield pd.DataFrame({"grp": g, key: part[key], "k": k, "cluster": _nearest(x, own)[0]})

    return points.select("grp", key, *columns).mapInPandas(label, f"grp int, {key} string, k int, cluster int")


def ari(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adjusted Rand index of labels ``a`` and ``b`` per group, from the contingency counts."""
    two = lambda c: c * (c - 1) / 2
    cells = pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(*by, "a").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias("_a"))
    columns = cells.groupBy(*by, "b").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias("_b"))
    inner = cells.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("_ab"), F.sum("n").alias("_n"))
    joined = inner.join(rows, list(by)).join(columns, list(by))
    expected = F.coalesce(F.try_divide(F.col("_a") * F.col("_b"), two(F.col("_n"))), F.lit(0.0))
    top = (F.col("_a") + F.col("_b")) / 2
    value = F.when(top == expected, 1.0).otherwise((F.col("_ab") - expected) / (top - expected))
    return joined.select(*by, value.alias("ari"))


def silhouette(labelled: DataFrame, key: str, columns: Sequence[str], seed: int, n: int = SILHOUETTE_SAMPLE) -> DataFrame:
    """Mean Euclidean silhouette per k on at most n customers (those of the smallest draws), the same ones for each k."""
    ranked = labelled.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(draw(key, seed=seed), key)))
    sample = ranked.filter(F.col("_r") <= n).select("k", "cluster", *columns)

    def score(group: pd.DataFrame) -> pd.DataFrame:
        x, label = group[list(columns)].to_numpy(dtype=float), group["cluster"].to_numpy()
        kinds = np.unique(label)
        value = None
        if 2 <= len(kinds) < len(label):
            distance = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(2))
            sums = np.stack([distance[:, label == c].sum(1) for c in kinds], axis=1)
            sizes = np.array([(label == c).sum() for c in kinds])
            own = np.searchsorted(kinds, label)
            rows = np.arange(len(label))
            inner = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
            other = sums / sizes
            other[rows, own] = np.inf
            outer = other.min(1)
            s = np.where(sizes[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
            value = float(s.mean())
        return pd.DataFrame({"k": [int(group["k"].iloc[0])], "silhouette": [value]})

    return sample.groupBy("k").applyInPandas(score, "k int, silhouette double")  # n rows per group at most


def choose_k(features: DataFrame, columns: Sequence[str], params: Analysis = Analysis(), key: str = "customer_id", floor_share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Candidate table and the labels of every k over the whole table.

    A candidate is publishable when its smallest cluster, silhouette and stability pass the gates; ``converged`` tells whether its
    models, on the whole table and on the subsamples, came to rest.
    """
    features = staged(features, "features")
    counted = features.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    vectors = features.select(*columns).distinct().limit(params.k_max + 1).count()
    ks = [k for k in range(params.k_min, min(params.k_max, counted, vectors) + 1)]
    if counted < 2 or vectors < 2 or not ks:
        empty = features.sparkSession.createDataFrame([], CANDIDATES)
        return empty, features.select(key, F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("cluster"))
    keyed = features.withColumn(key, F.col(key).cast("string"))
    scaled = robust_scale(_sample_groups(keyed, key, params.random_state), columns, ["grp"])
    points = staged(scaled.select("grp", key, *columns), "points")
    centres, _, rested = kmeans_many(points, key, columns, ks, params.n_init, params.random_state)
    labels = staged(assign(points, key, columns, centres), "labels")
    full = labels.filter(F.col("grp") == FULL)
    sizes = full.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(
        F.count(F.lit(1)).alias("cluster_count"), F.min("n").alias("min_cluster_size")
    )
    sub = labels.filter(F.col("grp") != FULL).withColumnRenamed("cluster", "b")
    pairs = sub.join(full.select(key, "k", F.col("cluster").alias("a")), [key, "k"])
    stability = ari(pairs, ["k", "grp"]).groupBy("k").agg(F.median("ari").alias("ari_median"))  # five values
    scored = silhouette(full.join(points.filter(F.col("grp") == FULL).drop("grp"), key), key, columns, params.random_state)
    floor = max(5, ceil(counted * floor_share))
    passed = (
        (F.col("min_cluster_size") >= floor)
        & F.coalesce(F.col("silhouette") >= 0.15, F.lit(False))
        & F.coalesce(F.col("ari_median") >= 0.65, F.lit(True))
    )
    settled = features.sparkSession.createDataFrame([(k, all(v for (_, j), v in rested.items() if j == k)) for k in ks], "k int, converged boolean")
    candidates = sizes.join(scored, "k", "left").join(stability, "k", "left").withColumn("publishable", passed).join(F.broadcast(settled), "k")
    return candidates, full.select(key, "k", "cluster")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Publishable first, then silhouette, then the smaller k (one row)."""
    return candidates.orderBy(
        F.col("publishable").desc(), F.coalesce("silhouette", F.lit(-1.0)).desc(), F.col("k")
    ).limit(1)


def cluster_profile(assigned: DataFrame, measures: Sequence[str] = ("recency_days", "frequency", "monetary")) -> DataFrame:
    """Size, share and exact medians per cluster."""
    total = assigned.agg(F.count(F.lit(1)).alias("_total")).withColumn("_k", F.lit(1))
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("customers"))
    out = sizes.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").select(
        "cluster", "customers", F.round(F.col("customers") / F.col("_total"), 6).alias("share")
    )
    for m in measures:
        out = out.join(exact_quantiles(assigned, m, {f"{m}_median": 0.5}, ["cluster"]), "cluster", "left")
    return out


def followups(orders: DataFrame, reference: date, publishable: bool = True) -> DataFrame:
    """Regular buyers whose present wait is clearly longer than usual, judged by their own gaps.

    Days are distinct first, so a customer brings at most one row per calendar day.
    """
    days = orders.filter(F.col("customer_id").isNotNull() & F.col("order_id").isNotNull()).select(
        "customer_id", F.to_date("event_time").alias("day")
    ).filter(F.col("day") < F.lit(reference)).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("customer_id").orderBy("day")))
    per = days.withColumn("gap", gap.cast("double")).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("purchase_days"),
        F.percentile("gap", F.lit(0.5)).alias("usual_gap_days"),
        (F.percentile("gap", F.lit(0.75)) - F.percentile("gap", F.lit(0.25))).alias("_iqr"),
        F.max("gap").alias("_max"),
        F.max("day").alias("last_purchase"),
    )
    usual, elapsed = F.col("usual_gap_days"), F.datediff(F.lit(reference), F.col("last_purchase"))
    threshold = F.greatest(usual * 1.5, usual + 7)
    late = (
        F.lit(publishable)
        & (F.col("purchase_days") >= 4)
        & (usual >= 1)
        & (F.col("_iqr") <= usual * 0.5)
        & (F.col("_max") <= usual * 2)
        & (elapsed > threshold)
        & (elapsed <= F.greatest(F.lit(90.0), usual * 3))
    )
    return per.filter(late).select(
        "customer_id", "purchase_days", "usual_gap_days", "last_purchase",
        elapsed.alias("days_since_purchase"), threshold.alias("threshold_days"),
    )


def followup_summary(found: DataFrame, customers: int) -> DataFrame:
    """The list's size and medians, empty unless it holds max(10, 1 %) of the customers. ``found`` is read several times, so it should be stored."""
    keyed = found.withColumn("_k", F.lit(1))
    out = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("customers"))
    for column, name in (
        ("purchase_days", "purchase_days_median"), ("usual_gap_days", "usual_gap_median"), ("days_since_purchase", "elapsed_median"),
    ):
        out = out.join(exact_quantiles(keyed, column, {name: 0.5}, ["_k"]), "_k")
    return out.filter(F.col("customers") >= max(10, ceil(customers * 0.01))).drop("_k")


def item_clusters(items: DataFrame, params: Analysis = Analysis(k_max=6)) -> tuple[DataFrame, DataFrame] | None:
    """Groups of comparable items on five features; a candidate may pass the numeric gates, but none is ever published by itself.

    ``items``: item_id, amount, weekly_cv, nonzero_day_share, change, observed_days. The log features
    are passed through expm1-safe columns, as scaling applies log1p itself.
    """
    ready = items.dropna(subset=["amount", "weekly_cv", "nonzero_day_share", "change"])
    if ready.limit(50).count() < 50:
        return None
    shaped = ready.select(
        "item_id",
        F.col("amount").alias("f0"),
        *[F.expm1(F.col(c)).alias(f"f{i + 1}") for i, c in enumerate(("weekly_cv", "nonzero_day_share", "change"))],
        F.coalesce("observed_days", F.lit(0)).cast("double").alias("f4"),
    )
    candidates, labels = choose_k(shaped, [f"f{i}" for i in range(5)], params, key="item_id", floor_share=0.02)
    return candidates.withColumnRenamed("publishable", "numeric_gate").withColumn("publishable", F.lit(False)), labels
