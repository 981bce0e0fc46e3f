"""N-gram Jaccard self-join by prefix trees, and the components of its links.

A document's set holds its distinct word 5-grams (all words as one, where there are fewer); two documents link when their sets'
Jaccard similarity reaches 3/4. All sets are sorted by one global order, frequent n-grams last, and each is a path in a trie. Linked sets
must share a node's n-gram within their prefixes (the first n - ceil(3n/4) + 1), so only the trie's upper part is kept, and it is cut into
independent subtrees by n-gram. A subtree is walked with its records in order of size: records whose remaining length cannot reach the overlap any
more are pruned, first by size and then by a parity sketch, whose differing bits never outnumber the sets' symmetric difference. What is left is verified on the whole sets,
read again from the texts.

Records that are linked already need no test among themselves: equal sets are one record; records that share one of their first n-grams
are tested against the smallest of them first; subtrees of a single component are dropped. Later rounds name for each record the nearest
record of every other component, and at last all pairs between components that no test has refuted. So no link between different
components is lost, and a large group of copies costs about one test per member.

The dealt trie is replaced by a prefix filter: postings of the first n-grams take the place of stored nodes, and no overlap is carried along
shared paths.

Global order: an n-gram's frequency class comes from counts over all documents; a task reports those that ``LOCAL`` of its documents have, and the classes decide speed only, never
a result. Sets are compared by 64-bit hashes.

Null, empty and white-space texts have no n-grams and link with nothing; their component is themselves. Rows without doc_id have no component.
Repeated rows are one record and each is returned. Other columns are not read. Lower-casing concerns A-Z only.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spread import attach
from .common import dropped, written

#: Words of an n-gram; the similarity as a fraction.
WORDS, SHARED, OF = 5, 3, 4
#: First n-grams of a set that records meet on at first; documents of a task that make an n-gram reported; least count of a frequent one.
HEADS, LOCAL, FREQUENT = 4, 4, 64
#: Most n-grams in the table of frequent ones (9 bytes each), and rows of a subtree task.
FREQUENT_ROWS, SUBTREE_ROWS = 4_000_000, 200_000
BITMAP = 1 << 26


#: A random 64-bit value per byte, and the odd base of the words' polynomials.
_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of a text that are hashed at once; a longer text is cut at white space.
CHUNK = 1 << 20


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^1 ... base^n, and base^0 ... base^-(n-1), modulo 2^64."""
    up = np.cumprod(np.full(n, _BASE, np.uint64))
    down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))
    return up, down


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash per word, from differences of one running polynomial over the bytes."""
    out, at = [], 0
    while at < len(raw):
        cut = re.compile(rb"[\t-\r ]").search(raw, at + CHUNK)
        part = np.frombuffer(raw[at : cut.start() if cut else len(raw)], np.uint8)
        at += len(part)
        up, down = powers(max(1 << 14, 1 << (len(part) - 1).bit_length()))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[part], [True]])))
        first, last = edges[0::2], edges[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * up[: len(part)], out=sums[1:])
        out.append(scrambled((sums[last] - sums[first]) * down[np.minimum(first, len(down) - 1)]))
    return np.concatenate([*out, np.zeros(0, np.uint64)])


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    ids = word_hashes((text or "").encode("utf-8").lower())
    if not len(ids):
        return ids
    k = min(WORDS, len(ids))
    mixed = np.full(len(ids) - k + 1, k, np.uint64)
    for j in range(k):
        mixed = scrambled((mixed + ids[j : j + len(mixed)]) * np.uint64(_BASE))
    mixed.sort()
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def linked(shared, a, b):
    """Similarity of at least SHARED / OF, in whole numbers."""
    return OF * shared >= SHARED * (a + b - shared)


def prefix_length(n: int) -> int:
    return n - -(-SHARED * n // OF) + 1 if n else 0


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens per slot; at least as many slots as tokens, a power of two."""
    slots = max(64, 1 << max(0, len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) folded to ``size`` bytes."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def records(docs: DataFrame) -> DataFrame:
    """doc_id, n, sig, key (its first half), head, sketch per document; and token, seen per n-gram that several documents of a task have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                sets = [ngrams(t) for t in b.column(1).to_pylist()]
                sigs = [signature(s) for s in sets]
                once = dict(zip(sigs, sets, strict=True))
                tokens, seen = np.unique(np.concatenate([*once.values(), np.zeros(0, np.uint64)]), return_counts=True)
                tokens, seen = tokens[seen >= LOCAL], seen[seen >= LOCAL]
                n, m = len(sets), len(tokens)
                heads = [s[:HEADS].view(np.int64).tolist() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([True] * n + [False] * m), pa.concat_arrays([b.column(0).cast(pa.int64()), pa.nulls(m, pa.int64())]), pa.array([len(s) for s in sets] + [None] * m, pa.int64()), pa.array(sigs + [None] * m, pa.binary()), pa.array([int.from_bytes(x[:8], "little", signed=True) for x in sigs] + [None] * m, pa.int64()),
                        pa.array(heads + [None] * m, pa.list_(pa.int64())), pa.array([sketch(s) for s in sets] + [None] * m, pa.binary()),
                        pa.array([None] * n + tokens.view(np.int64).tolist(), pa.int64()), pa.array([None] * n + seen.tolist(), pa.int64()),
                    ],
                    names=["is_doc", "doc_id", "n", "sig", "key", "head", "sketch", "token", "seen"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "is_doc boolean, doc_id long, n long, sig binary, key long, head array<long>, sketch binary, token long, seen long")


def frequent(found: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens above the frequency bound, sorted, with their class; at most FREQUENT_ROWS, as their counts add up to ``total`` at most."""
    least = max(FREQUENT, -(-total // FREQUENT_ROWS))
    rows = found.filter("not is_doc").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= least).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(rows["seen"].to_numpy(np.float64))[order].astype(np.uint8)


def ordered_prefix(tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The prefix of a set in the global order: by frequency class, then by hash."""
    known, classes = common
    if not len(known):
        return tokens[: prefix_length(len(tokens))]
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    level = np.where(known[at] == tokens, classes[at], 0)
    return tokens[np.argsort(level, kind="stable")[: prefix_length(len(tokens))]]


def reachable(token: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows (sorted by token, then n) have a partner under their token that size and remaining lengths allow."""
    keep = np.zeros(len(token), bool)
    rows, step = np.arange(len(token)), 0
    while len(rows):
        step += 1
        rows = rows[rows + step < len(token)]
        far = rows + step
        # partners grow with the step: a record is done at the end of its token, or when they have grown too large
        near = (token[far] == token[rows]) & (SHARED * n[far] <= OF * n[rows])
        rows, far = rows[near], far[near]
        fits = allowed(n[rows], pos[rows], n[far], pos[far])
        keep[rows[fits]] = keep[far[fits]] = True
    return keep


def allowed(n, pos, other_n, other_pos):
    """Whether two records that first meet at these places of theirs can still share enough."""
    needed = -(-SHARED * (n + other_n) // (OF + SHARED))
    return np.minimum(n - pos, other_n - other_pos) >= needed


def shared_nodes(docs: DataFrame, common, total: int) -> DataFrame:
    """token, key, n, pos (in the set's order) of every n-gram under which the prefixes of records can meet."""
    spark = docs.sparkSession
    told, parts = spark.sparkContext.broadcast(common), max(1, -(-total // (4 * SUBTREE_ROWS)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                seen: dict[bytes, np.ndarray] = {}
                for text in whole.column(0).slice(at, 2_000).to_pylist():
                    s = ngrams(text)
                    if len(s) and (sig := signature(s)[:8]) not in seen:
                        seen[sig] = ordered_prefix(s, told.value), len(s)
                if not seen:
                    continue
                cut, n = zip(*seen.values(), strict=True)
                size = [len(c) for c in cut]
                token = np.concatenate(cut)
                part = (token >> np.uint64(20)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                key = np.repeat(np.frombuffer(b"".join(seen), "<i8"), size)
                columns = [x[order] for x in (token, key, np.repeat(np.array(n, np.int32), size), np.concatenate([np.arange(k, dtype=np.int32) for k in size]))]
                some = [k for k in range(parts) if edge[k] < edge[k + 1]]
                raw = [pa.array([x[edge[k] : edge[k + 1]].tobytes() for k in some], pa.binary()) for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *raw], names=["part", "token", "key", "n", "pos"])

    def meet(batch: pd.DataFrame) -> pd.DataFrame:
        token, key, n, pos = (np.frombuffer(b"".join(batch[c]), t) for c, t in (("token", "<u8"), ("key", "<i8"), ("n", "<i4"), ("pos", "<i4")))
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        order = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
        order = order[np.lexsort((key[order], n[order], token[order]))]
        token, key, n, pos = token[order], key[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        # copies of a set are one record
        new = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])] if len(token) else np.zeros(0, bool)
        token, key, n, pos = token[new], key[new], n[new], pos[new]
        keep = reachable(token, n, pos)
        return pd.DataFrame({"token": token[keep].view(np.int64), "key": key[keep], "n": n[keep], "pos": pos[keep]})

    packed = docs.select("text").mapInArrow(emit, "part int, token binary, key binary, n binary, pos binary")
    return packed.groupBy("part").applyInPandas(meet, "token long, key long, n long, pos long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of ``edges`` (a, b) reaches; smallest labels spread and jump until none changes."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = attach(both, labels.withColumnRenamed("node", "b"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        better = labels.join(near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        jump = attach(better, labels.select(F.col("node").alias("comp"), F.col("comp").alias("_far")), ["comp"])
        after = written(jump.select("node", "_old", F.least("comp", "_far").alias("comp")), "labels")
        dropped(labels)
        labels = after.select("node", "comp")
        if after.filter("comp <> _old").isEmpty():
            return labels


def wanted_ids(pairs: DataFrame) -> bytes:
    """A bitmap (of fixed size) of the hashes of all ids in ``pairs``; more bits than needed cost time only."""
    slot = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    words = ids.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {BITMAP}) & 63 as int))").alias("bit"))
    rows = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITMAP // 64, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.tobytes()


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``ok``: whether their whole sets link; stored."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(wanted_ids(pairs))
    slots = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).alias("_slot")).filter("doc_id is not null")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bits.value, np.uint64)
        for b in batches:
            slot = b.column(2).to_numpy().astype(np.uint64)
            hit = (wanted[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            some = b.filter(pa.array(hit.astype(bool)))
            for at in range(0, some.num_rows, 1_000):
                part = some.slice(at, 1_000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ngrams(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["id", "tokens"])

    held = written(slots.mapInArrow(sets, "id long, tokens binary"), "sets")

    @F.pandas_udf("boolean")
    def test(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            out.append(bool(linked(int((both[1:] == both[:-1]).sum()), len(a), len(b))) and len(a) > 0)
        return pd.Series(out)

    one = pairs.select("a", "b").join(held.select(F.col("id").alias("a"), F.col("tokens").alias("_x")), "a")
    two = one.join(held.select(F.col("id").alias("b"), F.col("tokens").alias("_y")), "b")
    out = written(two.select("a", "b", test("_x", "_y").alias("ok")), "tests")
    dropped(held)
    return out


def subtree_pairs(rows: pd.DataFrame, nearest: bool) -> pd.DataFrame:
    """Pairs (a, b) of different components under each n-gram of ``rows`` (token, id, n, pos, comp, sketch) that no bound prunes.

    All subtrees of a task are walked at once, step by step: at step k each record meets the k-th larger one under its n-gram. With
    ``nearest``, only the pair of least sketch distance for each record and other component is kept.
    """
    rows = rows.drop_duplicates(["token", "id"]).sort_values(["token", "n", "id"])
    token, ids, n, pos, comp = (rows[c].to_numpy() for c in ("token", "id", "n", "pos", "comp"))
    raw = rows["sketch"].to_numpy()
    width, slot, bits = np.array([len(x) for x in raw], np.int64), np.zeros(len(raw), np.int64), {}
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        slot[mine] = np.arange(len(mine))
        bits[w] = np.frombuffer(b"".join(raw[mine]), np.uint8).reshape(-1, w)
    left, right, apart = [], [], []
    active, step = np.arange(len(token)), 0
    while len(active):
        step += 1
        active = active[active + step < len(token)]
        far = active + step
        active = active[(token[far] == token[active]) & (SHARED * n[far] <= OF * n[active])]
        far = active + step
        fits = (comp[far] != comp[active]) & allowed(n[active], pos[active], n[far], pos[far])
        a, b = active[fits], far[fits]
        # partners of at most 4/3 a record's size have sketches as long, or twice as long
        for w in np.unique(width[a]).tolist():
            for v in (w, 2 * w):
                some = np.flatnonzero((width[a] == w) & (width[b] == v))
                for at in range(0, len(some), 50_000):
                    x, y = a[some[at : at + 50_000]], b[some[at : at + 50_000]]
                    d = np.bitwise_count(bits[w][slot[x]] ^ folded(bits[v][slot[y]], w)).sum(axis=1, dtype=np.int64)
                    near = d <= (n[x] + n[y]) * (OF - SHARED) // (OF + SHARED)
                    left.append(x[near])
                    right.append(y[near])
                    apart.append(d[near])
    if not left:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    x, y, d = np.concatenate(left), np.concatenate(right), np.concatenate(apart)
    if nearest:
        best = np.lexsort((ids[y], d, comp[y], ids[x]))
        x, y = x[best], y[best]
        new = np.r_[True, (ids[x][1:] != ids[x][:-1]) | (comp[y][1:] != comp[y][:-1])] if len(x) else np.zeros(0, bool)
        x, y = x[new], y[new]
    return pd.DataFrame({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y])}).drop_duplicates()


def between(nodes: DataFrame, members: DataFrame, nearest: bool) -> DataFrame:
    """Candidate pairs (stored) between components, from the shared nodes whose records are of several components."""
    labelled = attach(nodes, members.select("key", "id", "comp"), ["key"]).filter("id is not null").select("token", "id", "n", "pos", "comp")
    labelled = written(labelled, "labelled-nodes")
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("_least"), F.max("comp").alias("_most")).filter("_least < _most").select("token", F.lit(True).alias("_mixed"))
    some = attach(labelled, mixed, ["token"]).filter("_mixed").select("token", "id", "n", "pos", "comp")
    whole = some.join(members.select("id", "sketch"), "id")
    tasks = max(1, -(-labelled.count() // (SUBTREE_ROWS // 20)))
    dealt = whole.withColumn("_part", F.pmod(F.xxhash64("token"), F.lit(tasks)))
    out = written(dealt.groupBy("_part").applyInPandas(lambda rows: subtree_pairs(rows, nearest), "a long, b long").distinct(), "pairs")
    dropped(labelled)
    return out


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    found = written(records(docs), "ngram-records")
    rows = found.filter("is_doc").select("doc_id", "n", "sig", "key", "head", "sketch")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t
    first = F.min(F.struct("doc_id", "n", "key", "head", "sketch")).alias("_f")
    sets = rows.filter("n > 0 and doc_id is not null").groupBy("sig").agg(first)
    classes = written(sets.select("sig", F.col("_f.doc_id").alias("id"), "_f.key", "_f.head", "_f.sketch"), "ngram-classes")

    # equal first n-grams: every record against the smallest
    heads = classes.select("id", F.explode("head").alias("token"))
    least = heads.groupBy("token").agg(F.min("id").alias("star"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    pairs = written(attach(heads, least, ["token"]).filter("star < id").select(F.col("star").alias("a"), F.col("id").alias("b")).distinct(), "pairs-heads")
    tested = verified(docs, pairs)
    nodes = written(shared_nodes(docs, frequent(found, total), total), "shared-nodes")
    for k, nearest in enumerate((True, False)):
        labels = components(tested.filter("ok")).withColumnRenamed("node", "id")
        members = classes.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"), "sketch")
        fresh = between(nodes, members, nearest)
        pairs = written(fresh.join(tested.select("a", "b"), ["a", "b"], "left_anti"), f"pairs-{k}")
        if pairs.isEmpty():
            continue
        tested = tested.union(verified(docs, pairs))
    labels = components(tested.filter("ok"))
    # a set's component is its smallest document's; the sets' table is small beside the rows, whose hot sets can be split
    comp = classes.select("sig", F.col("id").alias("node")).join(labels, "node", "left").select("sig", F.coalesce("comp", "node").alias("component_id"))
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return attach(rows.select("doc_id", "n", "sig"), comp, ["sig"]).select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def without_copies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the smallest document of every component; rows without doc_id stay."""
    others = joined(docs).filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(key))
    # the list of copies grows with the documents: a sort-merge join at every size, never a broadcast
    return docs.join(written(others, "near-copies").hint("merge"), key, "left_anti")
