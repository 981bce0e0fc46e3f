"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Index: each vector less the centre (the mean of all vectors) is turned by one random rotation; the signs of its
coordinates are packed into bits. Two scalars correct the estimate: the length of the difference, and the inner
product of the unit difference with its code. For a query q, with x the code divided by sqrt(d) and o the unit difference,

    <v, q> = <centre, q> + |v - centre| * <o, q>,     <o, q> is about <x, Rq> / <x, o>

and the estimate errs by at most |q| * sqrt((1 - <x, o>^2) / (<x, o>^2 * (d - 1))) * EPSILON but with a very small
probability. In the first block of vectors, the best k by estimate are computed exactly, which gives a floor for the k-th score;
every vector whose upper bound reaches the floor is reranked exactly. The best k so far give the floor of the next block.

Groups of at most some QUERY_ROWS queries meet every one of SLICES slices of the index, both dealt by hash, so equal vectors spread. A task reads a slice
block by block and hands over k rows a query, so rows handed over grow with the queries, whatever the index. The comparisons
of codes still grow with queries times vectors.

No part take: null vectors and ids, zero vectors, vectors with null or non-finite components, and those not of the most
frequent dimension. Rows of a query's own id are no candidates for it; a repeated query id counts once. Ties go to the smaller id. With fewer
candidates than k, all are returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Width of the error bounds in standard deviations.
EPSILON = 4.0
#: Vectors of the index in a block, queries in a group, slices of the index.
BLOCK_ROWS, QUERY_ROWS, SLICES = 2_048, 8_192, 12


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, vector array<double>) of the vectors that take part."""
    v = vectors.select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def centre(v: DataFrame, d: int) -> np.ndarray:
    """The mean of all vectors; one partial sum per batch, one row per dimension in the end."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(x.sum(axis=0)), pa.array(np.full(d, len(x)))], names=["at", "s", "n"])

    got = v.select("vector").mapInArrow(sums, "at long, s double, n long").groupBy("at").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("at").collect()
    return np.array([r.m for r in got])


def indexed(v: DataFrame, middle: np.ndarray, seed: int) -> DataFrame:
    """(id, raw: the vector's doubles, code: packed bits, length, match) of every vector."""
    d = len(middle)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d, seed)
        for b in batches:
            x = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            away = x - middle
            length = np.sqrt((away * away).sum(axis=1))
            turned = (away / np.where(length > 0, length, 1)[:, None]) @ turn.T
            code = np.packbits(turned > 0, axis=1)
            match = np.abs(turned).sum(axis=1) / math.sqrt(d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(length), pa.array(match)], names=["id", "raw", "code", "length", "match"])

    return v.mapInArrow(encode, f"id {v.schema['id'].dataType.simpleString()}, raw binary, code binary, length double, match double")


def joined(best: list[tuple[np.ndarray, np.ndarray]], asked: tuple[np.ndarray, np.ndarray], block: pd.DataFrame, middle: np.ndarray, turn: np.ndarray, k: int, epsilon: float) -> None:
    """Let one block of the index into each query's (ids, scores) of its best k so far; the k-th of them is the floor from the second block on."""
    d = len(middle)
    x = np.frombuffer(b"".join(block["raw"]), np.float64).reshape(-1, d)
    ids = block["id"].to_numpy(np.int64)
    bits = np.unpackbits(np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(x), -1), axis=1, count=d)
    signs = (bits.astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
    length, match = block["length"].to_numpy(), block["match"].to_numpy()
    match = np.where(length > 0, match, 1.0)
    spread = length * np.sqrt(np.maximum(0.0, 1 - match**2) / (match**2 * max(1, d - 1)))
    own, vectors = asked
    for first in range(0, len(own), 256):
        q = vectors[first : first + 256]
        guess = ((q @ turn.T).astype(np.float32) @ signs.T) * (length / match) + (q @ middle)[:, None]
        reach = guess + spread * (epsilon * np.sqrt((q * q).sum(axis=1)))[:, None] + 1e-5
        for j, vector in enumerate(q):
            known_ids, known = best[first + j]
            allowed = ids != own[first + j]
            floor = known[-1] if len(known) == k else -np.inf
            if len(known) < k < np.count_nonzero(allowed):
                top = np.argpartition(np.where(allowed, -guess[j], np.inf), k - 1)[:k]
                floor = (x[top] * vector).sum(axis=1).min()
            near = np.flatnonzero((reach[j] >= floor) & allowed)
            exact = (x[near] * vector).sum(axis=1)
            good = ~(exact < floor)
            found, scores = np.concatenate([known_ids, ids[near[good]]]), np.concatenate([known, exact[good]])
            order = np.lexsort((found, -scores))[:k]
            best[first + j] = found[order], scores[order]


FOUND = "query_id long, vec_id long, score double"


def searched(rows: DataFrame, middle: np.ndarray, k: int, seed: int, epsilon: float = EPSILON) -> DataFrame:
    """The k best of each (group of queries, slice of the index); ``rows`` hold every pair's queries, which have no code, right before its slice."""
    d = len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, at, waiting, asked, best = rotation(d, seed), None, [], None, []

        def result() -> pa.RecordBatch:
            sizes = [len(ids) for ids, _ in best]
            owners = np.repeat(asked[0], sizes) if best else np.zeros(0, np.int64)
            columns = [np.concatenate([part[c] for part in best]) if best else np.zeros(0, (np.int64, np.float64)[c]) for c in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(owners), *map(pa.array, columns)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for pair, part in b.to_pandas().groupby(["_q", "_s"], sort=False):
                if pair != at:
                    yield result()
                    at, waiting, asked, best = pair, [], None, []
                query = part["code"].isna()
                waiting.append(part.loc[query, ["id", "raw"]])
                data = part[~query]
                if data.empty or not sum(map(len, waiting)):
                    continue
                if asked is None:
                    whole = pd.concat(waiting)
                    asked = whole["id"].to_numpy(np.int64), np.frombuffer(b"".join(whole["raw"]), np.float64).reshape(-1, d)
                    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(whole)
                for first in range(0, len(data), BLOCK_ROWS):
                    joined(best, asked, data.iloc[first : first + BLOCK_ROWS], middle, turn, k, epsilon)
        yield result()

    return rows.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", embedding: str = "embedding", seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest; ``is_query`` is a condition on ``id``."""
    v = usable(vectors, key, embedding)
    shape = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = shape.d if shape else 1
    v = v.filter(F.size("vector") == d)
    middle = centre(v, d) if shape else np.zeros(1)
    index = written(indexed(v, middle, seed), "onebit-index")
    asked = index.filter(is_query).select("id", "raw").dropDuplicates(["id"])
    groups = max(1, math.ceil(asked.count() / QUERY_ROWS))
    code = ["code", "length", "match"]
    data = index.select(F.col("id").cast("long"), "raw", *code, F.pmod(F.xxhash64("id", "raw"), F.lit(SLICES)).cast("int").alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_q"))
    ask = asked.select(
        F.col("id").cast("long"), "raw", *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in code],
        F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("_s"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("_q"),
    )
    pairs = data.unionByName(ask).repartition(groups * SLICES, "_q", "_s").sortWithinPartitions("_q", "_s", F.col("code").isNotNull())
    found = searched(pairs, middle, k, seed)
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
