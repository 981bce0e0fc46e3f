"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words; every document of the source the same expected number of copies, target over
source size. The whole part of that number is taken for sure, the fractional part is a probability. Pairs meet: mass
(probability times words) moves from a document to its partner or back, in a random direction that leaves all expectations
as they are, until one probability is 0 or 1. The partner is the pooled rest of the block, smaller documents all, as long as it
has the room, else the next document. So the source's words stay at its target throughout; only the last document of a source, one of the
smallest, is rounded (to the nearer side).

Documents meet inside blocks by a hash of the row, one residual per source and block is left, and residuals meet in a
tree of ``FAN`` blocks a level; no task holds more than a block, whatever the source's size.

Null source: a source of its own, last in order. Null, empty and white-space texts have size 0 and take no words; a table without words
has targets of 0. Repeated rows meet as separate documents. Draws come from the rows, so reruns agree. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ranked, source_key, written

BLOCK_ROWS, FAN = 1_000, 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, budget: float, most: float) -> DataFrame:
    """``target`` per source from (source_size, weight): shares of ``budget`` times all sizes, none above ``most`` times its size.

    The excess of full sources goes to the others by weight. The level (words per unit of weight) at which the budget is met is found
    from one summary row a round; a source that is full stays full, so the rounds end.
    """
    cap, level = F.col("source_size") * F.lit(float(most)), 0.0
    whole = sizes.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total = float(whole.s or 0) * budget
    if total:
        total, level = min(total, most * float(whole.s)), total / float(whole.w)
    while total:
        full = cap <= F.col("weight") * F.lit(level)
        got = sizes.agg(F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        after = (total - float(got.full or 0)) / float(got.open) if got.open else level
        if after <= level:
            break
        level = after
    return sizes.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def settle(size: np.ndarray, p: np.ndarray, draw: np.random.Generator) -> int:
    """Round ``p`` in place by transfers, largest documents first; returns the place of the one still open, or -1.

    A document's partner is the rest, each of whose probabilities moves by the same amount, as long as none of them would leave
    [0, 1] in either direction; else it is the next document alone. Both keep all expectations and the words.
    """
    for i in range(len(p)):
        while 0 < p[i] < 1:
            rest = i + 1 + np.flatnonzero((p[i + 1 :] > 0) & (p[i + 1 :] < 1))
            if not len(rest):
                return i
            weight, others = size[rest].sum(), p[rest]
            less, more = (1 - p[i]) * size[i] / weight, p[i] * size[i] / weight
            if less <= others.min() and more <= 1 - others.max():
                taken = draw.random() < p[i]
                p[rest] = _snap(others - less if taken else others + more)
                p[i] = float(taken)
                continue
            j = rest[0]
            up, down = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
            move = up if draw.random() * (up + down) < down else -down
            p[i], p[j] = _snap(p[i] + move / size[i]), _snap(p[j] - move / size[j])
    return -1


def _snap(x):
    return np.where(x < 1e-9, 0.0, np.where(x > 1 - 1e-9, 1.0, x))


def rounded(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (_null, _source, size, _p, _h, _block ...) with ``_p`` at 0 or 1, level by level."""
    schema = rows.withColumn("_open", F.lit(False)).schema
    n = rows.agg((F.coalesce(F.max("_block"), F.lit(-1)) + 1).alias("n")).first().n
    level, decided = 0, []

    def level_of(depth: int, last: bool):
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            batch = batch.sort_values(["_null", "_source", "_block", "size", "_h"], ascending=[True, True, True, False, True], kind="stable").reset_index(drop=True)
            p, size, still = batch["_p"].to_numpy(float).copy(), batch["size"].to_numpy(float), np.zeros(len(batch), bool)
            for (_, _, block), places in batch.groupby(["_null", "_source", "_block"], sort=False).indices.items():
                part = p[places]
                draw = np.random.default_rng([seed, depth, int(block), *(int(h) & 0x7FFFFFFFFFFFFFFF for h in batch["_h"].to_numpy()[places[:1]])])
                left = settle(size[places], part, draw)
                if left >= 0 and last:
                    part[left] = float(part[left] >= 0.5)
                elif left >= 0:
                    still[places[left]] = True
                p[places] = part
            return batch.assign(_p=p, _open=still).drop(columns="_bucket")

        return run

    while True:
        last = n <= 1
        # at first a bucket is a block of all sources; later, blocks of a source stay together and are dealt evenly
        buckets = max(1, math.ceil(rows.count() / BLOCK_ROWS)) if level else 0
        key = F.pmod(F.xxhash64("_null", "_source", "_block"), F.lit(buckets)) if level else F.col("_block")
        done = written(rows.withColumn("_bucket", key).groupBy("_bucket").applyInPandas(level_of(level, last), schema), f"mixture-{level}")
        if last:
            return _together([*decided, done]).drop("_open")
        decided.append(done.filter(~F.col("_open")))
        n = math.ceil(n / FAN)
        rows = done.filter("_open").drop("_open").withColumn("_block", F.floor(F.col("_block") / FAN).cast("int"))
        level += 1


def _together(parts: list[DataFrame]) -> DataFrame:
    out, *rest = parts
    for p in rest:
        out = out.union(p)
    return out


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """Copies of every document: doc_id, source, size, source_size, target, copies, taken.

    Sources in order of code points, null last, take ``weights`` in turn.
    """
    narrow = docs.select("doc_id", *source_key(F.col("source")), words(F.col("text")).alias("size"))
    rows = written(narrow.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size")), "mixture-rows")
    sizes = rows.groupBy("_null", "_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    order = ranked(sizes, [], ["_null", "_source"], "mixture-sources")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    shares = written(targets(written(order.select("_null", "_source", "source_size", "_docs", turn.alias("weight")), "mixture-weights"), budget, most), "mixture-targets")
    n = shares.agg(F.coalesce(F.sum("_docs"), F.lit(0)).alias("n")).first().n
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    # both sides are stored tables, so a hot source's rows can be split among tasks
    joined = rows.join(shares.drop("_docs", "weight"), ["_null", "_source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(rate + F.lit(1e-12)).cast("int")
    parts = joined.withColumn("_base", base).withColumn("_p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), rate - base)).otherwise(F.lit(0.0)))
    out = rounded(parts.withColumn("_block", F.pmod(F.col("_h"), F.lit(blocks)).cast("int")), seed)
    copies = (F.col("_base") + F.col("_p").cast("int")).alias("copies")
    source = F.when(~F.col("_null"), F.col("_source")).alias("source")
    return out.select("doc_id", source, "size", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def repeated(docs: DataFrame, mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` as often as ``mix`` (from ``mixed``) takes them; only the key and the copies meet the texts. Rows without a key stay once."""
    times = mix.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("copies").alias("__copies"))
    # the table of copies grows with the documents: a sort-merge join at every size, never a broadcast
    met = docs.join(written(times, "mixture-copies").hint("merge"), key, "left")
    copies = F.when(F.col(key).isNull(), F.lit(1)).otherwise(F.coalesce("__copies", F.lit(0)))
    return met.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])
