"""Histogram boosting of many models in the same Spark passes.

Squared error, leaf-wise trees with an L2 term. Every key of the training rows (a forecast's origin, say) has a model of its own. A pass adds up
gradients per (key, node, feature, bin) inside each task; tasks hand over one array per (key, node), these are summed and searched for the
best split in the cluster, and only the splits come back. All keys go through the same passes, each at its own pace: one that finishes a tree begins
the next in the following pass. Leaves open in order of gain; children of every leaf that may still be opened are measured at once, so a tree takes about as
many passes as it is deep. Models of at most ``LOCAL_ROWS`` training rows need no passes: each of them is grown by one task in the same steps, all at once.

What the driver holds is bounded by the number of keys and the settings: cut points (keys x features x bins) and trees (keys x trees x leaves). The rows
stay in the cluster; their running predictions are written anew after every ``STORED`` trees, so a pass evaluates few trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import spent, staged

#: Finished trees of a model after which the rows' predictions are written.
STORED = 10
#: Most training rows of a model that one task grows (a byte per feature and two numbers each).
LOCAL_ROWS = 200_000
#: Bins of a histogram; the last ones stay empty where a feature has fewer cuts.
WIDTH = 256


@dataclass(frozen=True)
class Boosting:
    """Settings; a model needs ``least`` training rows, a leaf ``leaf_rows``."""

    trees: int = 80
    leaves: int = 15
    leaf_rows: int = 15
    l2: float = 2.0
    rate: float = 0.1
    bins: int = 255
    least: int = 30


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf has feature -1. Rows with a bin of at most ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The node each row (of bins) ends in."""
        node, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(open_):
            open_ = open_[self.feature[node[open_]] >= 0]
            at = node[open_]
            goes_left = x[open_, self.feature[at]] <= self.cut[at]
            node[open_] = np.where(goes_left, self.left[at], self.right[at])
        return node

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x)]


@dataclass
class Model:
    """Start value, cut points per feature (a value's bin is the number of cuts below it) and trees."""

    base: float
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of values; a missing value is larger than all."""
        return np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(self.cuts)]).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return self.base + sum((t.values(bins) for t in self.trees), np.zeros(len(x)))


@dataclass
class Node:
    rows: float = 0.0
    gradient: float = 0.0
    measured: bool = False
    split: tuple | None = None  # gain, feature, cut, rows and gradient of the left part
    children: tuple[int, int] | None = None


class Growth:
    """A tree on its way: the nodes measured so far and those to measure next."""

    def __init__(self, settings: Boosting):
        self.settings, self.nodes = settings, [Node()]

    def open_leaves(self) -> tuple[list[int], bool]:
        """Open leaves in order of gain; the nodes opened, and whether no unmeasured one could have come first."""
        frontier, opened, sure = [0], [], True
        while len(opened) < self.settings.leaves - 1:
            ready = [i for i in frontier if self.nodes[i].split]
            sure = sure and all(self.nodes[i].measured for i in frontier)
            if not ready:
                break
            best = max(ready, key=lambda i: (self.nodes[i].split[0], -i))
            frontier.remove(best)
            frontier += self.opened(best)
            opened.append(best)
        return opened, sure

    def opened(self, at: int) -> tuple[int, int]:
        node = self.nodes[at]
        if node.children is None:
            _, _, _, rows, gradient = node.split
            node.children = len(self.nodes), len(self.nodes) + 1
            for n, g in ((rows, gradient), (node.rows - rows, node.gradient - gradient)):
                # too few rows for two leaves: nothing to measure
                self.nodes.append(Node(n, g, n < 2 * self.settings.leaf_rows))
        return node.children

    def unmeasured(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if not n.measured]

    def measure(self, at: int, rows: float, gradient: float, split: tuple | None) -> None:
        node = self.nodes[at]
        node.rows, node.gradient, node.split, node.measured = rows, gradient, split, True

    def tree(self, opened: list[int]) -> Tree:
        """The tree of the opened nodes; with all that have children, the one that routes rows during growth."""
        s, inner = self.settings, set(opened)
        feature, cut, left, right, value = [], [], [], [], []
        for i, n in enumerate(self.nodes):
            split = i in inner
            feature.append(n.split[1] if split else -1)
            cut.append(n.split[2] if split else 0)
            left.append(n.children[0] if split else 0)
            right.append(n.children[1] if split else 0)
            value.append(-s.rate * n.gradient / (n.rows + s.l2) if n.rows else 0.0)
        return Tree(np.array(feature, np.int32), np.array(cut, np.int32), np.array(left, np.int32), np.array(right, np.int32), np.array(value))

    def routes(self) -> Tree:
        return self.tree([i for i, n in enumerate(self.nodes) if n.children])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def start(train: DataFrame, key: str, features: Sequence[str], label: str, settings: Boosting) -> tuple[dict[int, Model], dict[int, int]]:
    """Mean and cut points of every key with rows enough, and its number of rows: one aggregation, a row per key."""
    steps = F.array(*[F.lit(k / settings.bins) for k in range(1, settings.bins)])
    cuts = [F.percentile_approx(F.col(c).cast("double"), steps, F.lit(10_000)).alias(f"_c{k}") for k, c in enumerate(features)]
    rows = train.groupBy(F.col(key).alias("_key")).agg(F.count(label).alias("_n"), F.avg(label).alias("_mean"), *cuts).collect()
    models = {
        r["_key"]: Model(r["_mean"], [np.unique(np.array(r[f"_c{k}"] or [], float)) for k in range(len(features))])
        for r in rows if r["_n"] >= settings.least
    }
    return models, {r["_key"]: r["_n"] for r in rows}


def binned(train: DataFrame, key: str, features: Sequence[str], label: str, models: dict[int, Model]) -> DataFrame:
    """key, bins (a byte per feature), label and running prediction of the training rows, neighbours in key kept together."""
    known = train.sparkSession.sparkContext.broadcast(models)
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]]).astype(float)
            bins, raw, kept = np.zeros((len(keys), width), np.uint8), np.zeros(len(keys)), np.zeros(len(keys), bool)
            for k in np.unique(keys).tolist():
                if k in known.value:
                    at = keys == k
                    bins[at], raw[at], kept[at] = known.value[k].binned(x[at]), known.value[k].base, True
            at = np.flatnonzero(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at], pa.int64()), pa.array([r.tobytes() for r in bins[at]], pa.binary()), b.column(1).take(pa.array(at)), pa.array(raw[at])],
                names=["key", "bins", "label", "raw"],
            )

    numbers = train.filter(F.col(label).isNotNull()).select(F.col(key).cast("long"), F.col(label).cast("double"), *[F.col(c).cast("double") for c in features])
    rows = numbers.mapInArrow(run, "key long, bins binary, label double, raw double")
    return rows.repartitionByRange("key", F.xxhash64("bins", "label"))


def advanced(rows: DataFrame, trees: dict[int, list[Tree]], width: int) -> DataFrame:
    """Rows with ``raw`` moved on by further trees of their key."""
    more = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, raw, x = b.column(0).to_numpy(), b.column(3).to_numpy().copy(), matrix(b.column(1), width)
            for k in np.unique(keys).tolist():
                at = np.flatnonzero(keys == k)
                for t in more.value.get(k, ()):
                    raw[at] += t.values(x[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raw)], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def sums_of(x: np.ndarray, off: np.ndarray, trees: Sequence[Tree], routes: Tree, wanted: Sequence[int]) -> np.ndarray:
    """Sums of gradients, then of rows, per wanted node, feature and bin; ``off`` are prediction less label, before ``trees``."""
    width = x.shape[1]
    for t in trees:
        off = off + t.values(x)
    place = np.full(len(routes.feature), -1)
    place[list(wanted)] = np.arange(len(wanted))
    slot = place[routes.leaf(x)]
    hit = slot >= 0
    cells = ((slot[hit] * width * WIDTH)[:, None] + np.arange(width) * WIDTH + x[hit]).ravel()
    size = len(wanted) * width * WIDTH
    return np.stack([np.bincount(cells, np.repeat(off[hit], width), size), np.bincount(cells, minlength=size)]).reshape(2, len(wanted), width, WIDTH)


def histograms(rows: DataFrame, work: dict[int, tuple[list[Tree], Tree, list[int]]], width: int) -> DataFrame:
    """key, node and sums per task: gradients, then rows, of every (feature, bin) of the nodes to measure."""
    shared = rows.sparkSession.sparkContext.broadcast(work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            keys = b.column(0).to_numpy()
            x, off = matrix(b.column(1), width), b.column(3).to_numpy() - b.column(2).to_numpy()
            for k in np.unique(keys).tolist():
                if k in shared.value:
                    at = np.flatnonzero(keys == k)
                    found = sums_of(x[at], off[at], *shared.value[k])
                    sums[k] = sums[k] + found if k in sums else found
        out = [(k, node, np.ascontiguousarray(s[:, i]).tobytes()) for k, s in sums.items() for i, node in enumerate(shared.value[k][2])]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["key", "node", "sums"])

    return rows.mapInArrow(run, "key long, node int, sums binary")


SPLIT = "key long, node int, feature int, cut int, gain double, rows_left double, gradient_left double, n double, gradient double"


def best_split(gradients: np.ndarray, rows: np.ndarray, settings: Boosting) -> tuple | None:
    """gain, feature, cut, rows and gradient of the left part; ties go to the first feature and cut. Arrays are (feature, bin)."""
    g, n = gradients.cumsum(axis=1), rows.cumsum(axis=1)
    total_g, total_n = g[:, -1:], n[:, -1:]
    fit = lambda s, k: s * s / (k + settings.l2)
    gain = fit(g, n) + fit(total_g - g, total_n - n) - fit(total_g, total_n)
    allowed = (n >= settings.leaf_rows) & (total_n - n >= settings.leaf_rows)
    gain = np.where(allowed, gain, -np.inf)
    f, c = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, c]), int(f), int(c), float(n[f, c]), float(g[f, c])) if gain[f, c] > 1e-12 else None


def splits(parts: DataFrame, width: int, settings: Boosting) -> DataFrame:
    """The best split per (key, node) from the tasks' sums; feature -1 where there is none."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((2, width, WIDTH))
        for part in pdf["sums"]:
            total += np.frombuffer(part).reshape(2, width, WIDTH)
        n, g = total[1, 0].sum(), total[0, 0].sum()
        found = best_split(total[0], total[1], settings) or (0.0, -1, 0, 0.0, 0.0)
        gain, f, c, rows_left, gradient_left = found
        return pd.DataFrame([(pdf["key"].iloc[0], pdf["node"].iloc[0], f, c, gain, rows_left, gradient_left, n, g)], columns=[c.split()[0] for c in SPLIT.split(", ")])

    return parts.groupBy("key", "node").applyInPandas(best, SPLIT)


def grown(x: np.ndarray, label: np.ndarray, raw: np.ndarray, settings: Boosting) -> Iterator[Tree]:
    """The trees of one model whose rows are at hand."""
    off = raw - label
    for _ in range(settings.trees):
        growth, sure = Growth(settings), False
        while not sure:
            wanted = growth.unmeasured()
            sums = sums_of(x, off, (), growth.routes(), wanted)
            for i, node in enumerate(wanted):
                growth.measure(node, sums[1, i, 0].sum(), sums[0, i, 0].sum(), best_split(sums[0, i], sums[1, i], settings))
            opened, sure = growth.open_leaves()
        tree = growth.tree(opened)
        off = off + tree.values(x)
        yield tree


TREE = "key long, number int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>"


def fit_local(rows: DataFrame, keys: int, width: int, settings: Boosting) -> dict[int, list[Tree]]:
    """The trees of every one of the ``keys`` keys, each grown in one task and once."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        # the order of the rows decides rounding only; it is fixed so that reruns agree
        pdf = pdf.sort_values(["bins", "label"])
        x = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, width)
        trees = grown(x, pdf["label"].to_numpy(), pdf["raw"].to_numpy(), settings)
        rows = [(pdf["key"].iloc[0], i, *[a.tolist() for a in (t.feature, t.cut, t.left, t.right, t.value)]) for i, t in enumerate(trees)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TREE.split(", ")])

    # a stated number of partitions: small models must not be put into one task, however few bytes their rows have. The trees are
    # put in order here, as a sort in the cluster would grow them once more for its sample.
    apart = rows.repartition(max(1, keys), "key").groupBy("key").applyInPandas(grow, TREE)
    found: dict[int, list[Tree]] = {}
    for r in sorted(apart.collect(), key=lambda r: (r["key"], r["number"])):
        whole = [np.array(r[c], np.int32) for c in ("feature", "cut", "left", "right")]
        found.setdefault(r["key"], []).append(Tree(*whole, np.array(r["value"])))
    return found


def fit(train: DataFrame, key: str, features: Sequence[str], label: str, settings: Boosting = Boosting()) -> dict[int, Model]:
    """A model per key (whole numbers) of the training rows; keys with fewer than ``least`` rows have none."""
    models, sizes = start(train, key, features, label, settings)
    if not models or not settings.trees:
        return models
    rows = staged(binned(train, key, features, label, models), "boosting-rows")
    small = [k for k in models if sizes[k] <= LOCAL_ROWS]
    if small:
        for k, trees in fit_local(rows.filter(F.col("key").isin(small)), len(small), len(features), settings).items():
            models[k].trees += trees
    large = {k: m for k, m in models.items() if k not in set(small)}
    fit_in_passes(rows, large, len(features), settings)
    return models


def fit_in_passes(rows: DataFrame, models: dict[int, Model], width: int, settings: Boosting) -> None:
    """Grow the trees of all given models together; ``rows`` (a staged table) are deleted at the end."""
    growing = {k: Growth(settings) for k in models}
    pending: dict[int, list[Tree]] = {k: [] for k in models}
    while growing:
        work = {k: (pending[k], g.routes(), g.unmeasured()) for k, g in growing.items()}
        for r in splits(histograms(rows, work, width), width, settings).collect():
            split = (r["gain"], r["feature"], r["cut"], r["rows_left"], r["gradient_left"]) if r["feature"] >= 0 else None
            growing[r["key"]].measure(r["node"], r["n"], r["gradient"], split)
        for k in list(growing):
            opened, sure = growing[k].open_leaves()
            if not sure:
                continue
            tree = growing[k].tree(opened)
            models[k].trees.append(tree)
            pending[k].append(tree)
            growing[k] = Growth(settings)
            if len(models[k].trees) == settings.trees:
                del growing[k]
        if growing and max(len(p) for p in pending.values()) >= STORED:
            old, rows = rows, staged(advanced(rows, pending, width), "boosting-rows")
            spent(old)
            pending = {k: [] for k in models}
    spent(rows)


def predicted(rows: DataFrame, key: str, features: Sequence[str], models: dict[int, Model], name: str) -> DataFrame:
    """``rows`` of keys that have a model, with its prediction."""
    known = rows.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def value(keys: pd.Series, *columns: pd.Series) -> pd.Series:
        x, out = np.column_stack([c.to_numpy(dtype=float) for c in columns]), np.full(len(keys), np.nan)
        for k in keys.unique():
            at = (keys == k).to_numpy()
            out[at] = known.value[k].predict(x[at])
        return pd.Series(out)

    own = rows.filter(F.col(key).isin([int(k) for k in models])) if models else rows.filter(F.lit(False))
    return own.withColumn(name, value(F.col(key), *[F.col(c).cast("double") for c in features]))
