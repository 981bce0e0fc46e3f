r"""Phrase collocations by prefix-free parsing.

A text is a row of words and breaks (``[.,;:!?\x0A-\x0D]``), A-Z lower-cased. Windows of ``longest - 1`` tokens whose hash is divisible by
``PERIOD`` are triggers; they alone decide where a text is cut, so repeated passages give equal chunks wherever they stand. A chunk runs from one trigger to the
end of the next one, and the last chunk ends in as many breaks. The distinct chunks with their frequencies are the dictionary. Phrases are counted inside distinct
chunks, weighted by frequency. Neighbouring chunks overlap by one window: a phrase belongs to the chunk in which it starts before the closing window, so
every occurrence is counted once, and as it is at most one word longer than the window, it lies whole in that chunk.

Words travel as 64-bit codes (a break is 0). The vocabulary tells whether any two words share a code; then the texts are parsed anew with other
codes, so counts are those of words. Phrases are codes one after the other, and only the final ones are spelled out.

Phrases are counted level by level: a phrase of k words is tried where both its parts of k - 1 words are frequent. A bitmap of at most
2^``MOST_BITS`` bits (16 MB) tells which parts may be frequent. It never misses one; full, it costs counting, no result. From three words on only the
stretches whose shorter phrases are all frequent are read again. A task adds up what it reads and hands over
sorted, compressed blocks by hash of the phrase, and a part of all phrases is added up at a time, so a frequent word or chunk is one entry per block.

Null text: empty. Null language: ``und``. Repeated rows count each time. Other columns are not read. Texts without words take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spread import attach
from .common import WordTable, dropped, written

#: One window of so many is a trigger (a power of two).
PERIOD = 64
#: Bits of the bitmap per frequent phrase, and its least and largest size as powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 27
#: Tokens of chunks that are looked at together, phrases a task holds before it hands them over, and rows it returns at a time.
BUFFER, HELD, SENT = 1 << 20, 1 << 21, 20_000
#: Words for one part of the phrases when they are added up, and the least number of parts.
PART_WORDS, LEAST_PARTS = 4_000_000, 32
#: Parts of a language that are ranked on their own before they meet.
RANKS = 64
#: Bytes of a word's code, and what stands for ``owned`` in rows of the vocabulary.
CODE, VOCABULARY = 8, -1

BREAK = b"\n"
_UPPER = bytes(range(65, 91))
_MAP = bytes.maketrans(_UPPER + b"\t" + b".,;:!?\x0b\x0c\r", _UPPER.lower() + b" " + BREAK * 9)
_ODD, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)

CHUNK = [("lang", pa.string()), ("chunk", pa.binary()), ("owned", pa.int32()), ("n", pa.int64())]
BLOCK = [("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())]
COUNT = [("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())]
CHUNK_DDL, BLOCK_DDL, COUNT_DDL = "lang string, chunk binary, owned int, n long", "part int, lang string, phrases binary, counts binary", "lang string, phrase binary, f long"


def tokens(raw: bytes | None) -> list[bytes]:
    """Words and breaks of a text."""
    return [t for t in (raw or b"").translate(_MAP).replace(BREAK, b" \n ").split(b" ") if t]


def word_code(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed) or 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _ODD
    return h ^ (h >> _SHIFT)


def phrase_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """A hash per phrase; ``columns`` are the codes of its first word, its second word and so on."""
    out = mixed(columns[0])
    for c in columns[1:]:
        out = mixed(out * _ODD + c)
    return out


def windows(codes: np.ndarray, n: int) -> list[np.ndarray]:
    """The codes of the n tokens from each position on, as columns."""
    size = max(0, len(codes) - n + 1)
    return [codes[k : k + size] for k in range(n)]


def chunks(codes: np.ndarray, window: int) -> list[np.ndarray]:
    """The overlapping chunks of a text."""
    triggers = np.flatnonzero(phrase_hashes(windows(codes, window)) & np.uint64(PERIOD - 1) == 0)
    starts = [0, *triggers[triggers > 0].tolist()]
    ended = np.concatenate([codes, np.zeros(window, np.uint64)])
    return [ended[a:b] for a, b in zip(starts, [s + window for s in starts[1:]] + [len(ended)], strict=True)]


def batch_of(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def parsed(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """lang, chunk (codes), owned (starts that are counted here) and n: the dictionary of distinct chunks with their frequencies.

    Rows whose ``owned`` is VOCABULARY hold a code and its word instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[tuple] = []

        def coded(word: bytes) -> int:
            if word == BREAK:
                return 0
            code = word_code(word, seed)
            fresh.append(("", code.to_bytes(CODE, "little") + word, VOCABULARY, 1))
            return code

        code_of = WordTable(coded).__getitem__
        for b in batches:
            seen: dict = {}
            for lang, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(raw)
                codes = np.fromiter(map(code_of, words), np.uint64, len(words))
                for chunk in chunks(codes, window) if words else ():
                    key = lang, chunk.tobytes()
                    seen[key] = seen.get(key, 0) + 1
            yield batch_of([(lang, chunk, len(chunk) // CODE - window, n) for (lang, chunk), n in seen.items()] + fresh, CHUNK)
            fresh.clear()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, CHUNK_DDL).groupBy("lang", "chunk", "owned").agg(F.sum("n").alias("n"))


class Tokens:
    """Codes of chunks of one language, side by side, with their times and whether a phrase counts where it starts."""

    def __init__(self, lang: str, chunks_: list[bytes], owned: list[int], times: list[int]):
        self.code = np.frombuffer(b"".join(chunks_), np.uint64)
        lengths = np.array([len(c) for c in chunks_], np.int64) // CODE
        self.row = np.repeat(np.arange(len(chunks_), dtype=np.int32), lengths)
        start = np.cumsum(lengths) - lengths
        self.owned = np.arange(len(self.code)) < (start + np.minimum(owned, lengths))[self.row]
        self.times = np.array(times, np.int64)
        self.lang = lang_hash(lang)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n tokens from each position on are words of one chunk."""
        columns = windows(self.code, n)
        hit = self.row[: len(columns[0])] == self.row[n - 1 : n - 1 + len(columns[0])]
        for c in columns:
            hit &= c != 0
        return hit

    def marked(self, bitmap: np.ndarray, n: int) -> np.ndarray:
        """Whether the phrase of n words from each position on may be in the bitmap."""
        return self.whole(n) & probed(bitmap, phrase_hashes(windows(self.code, n)), self.lang)

    def counted(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct phrases (a row of codes each) of n words at the positions, and their times."""
        rows = np.stack([self.code[at + k] for k in range(n)], axis=1)
        if n == 1:
            return reduced(rows, self.times[self.row[at]])
        # equal codes get equal small numbers, so that a phrase is one number again and again
        known, number = np.unique(self.code, return_inverse=True)
        group = number[at]
        for k in range(1, n):
            _, first, group = np.unique(group * len(known) + number[at + k], return_index=True, return_inverse=True)
        return rows[first], np.bincount(group, self.times[self.row[at]], len(first)).astype(np.int64)


def reduced(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, their counts added up."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.add.reduceat(counts[order], first)


def buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Tokens]]:
    """A task's chunks by language, some ``BUFFER`` tokens at a time."""
    held: dict = {}
    for b in batches:
        for lang, chunk, owned, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
            own = held.setdefault(lang, ([], [], [], [0]))
            own[0].append(chunk)
            own[1].append(owned)
            own[2].append(n)
            own[3][0] += len(chunk)
            if own[3][0] >= BUFFER * CODE:
                yield lang, Tokens(lang, *held.pop(lang)[:3])
    for lang, own in held.items():
        yield lang, Tokens(lang, *own[:3])


class Tally:
    """Counts of a task, handed over as sorted, compressed blocks: one per language and part of the phrases (by hash)."""

    def __init__(self, parts: int):
        self.parts, self.counts, self.size = parts, {}, 0

    def add(self, lang: str, phrases: np.ndarray, times: np.ndarray) -> bool:
        """Whether it is time to hand over."""
        self.counts.setdefault(lang, []).append((phrases, times))
        self.size += len(phrases)
        return self.size >= HELD

    def blocks(self) -> pa.RecordBatch:
        out, packer = [], zstandard.ZstdCompressor(level=1)
        for lang, own in self.counts.items():
            rows, counts = reduced(np.concatenate([r for r, _ in own]), np.concatenate([c for _, c in own]))
            part = (mixed(phrase_hashes(list(rows.T)) ^ lang_hash(lang)) >> _SHIFT).astype(np.int64) % self.parts
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(self.parts + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                mine = order[edges[k] : edges[k + 1]]
                out.append((k, lang, packer.compress(rows[mine].T.tobytes()), packer.compress(counts[mine].tobytes())))
        self.counts, self.size = {}, 0
        return batch_of(out, BLOCK)


def summed(blocks: DataFrame, parts: int, n: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """lang, phrase and f from the tasks' blocks; every part of the phrases is added up in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for lang, phrases, counts in zip(*[b.column(c).to_pylist() for c in ("lang", "phrases", "counts")], strict=True):
                total.setdefault(lang, []).append((np.frombuffer(unpack(phrases), np.uint64).reshape(n, -1).T, np.frombuffer(unpack(counts), np.int64)))
        for lang, own in total.items():
            rows, counts = reduced(np.concatenate([r for r, _ in own]), np.concatenate([c for _, c in own]))
            kept = np.flatnonzero(keep(rows, counts))
            for at in range(0, len(kept), SENT):
                some = kept[at : at + SENT]
                yield batch_of([(lang, r.tobytes(), c) for r, c in zip(rows[some], counts[some].tolist(), strict=True)], COUNT)

    return blocks.repartitionById(parts, "part").mapInArrow(run, COUNT_DDL)


def word_counts(chunks_: DataFrame, parts: int, least: int) -> DataFrame:
    """lang, phrase and f of every frequent word; code 0 has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(parts)
        for lang, t in buffered(batches):
            words, times = t.counted(np.flatnonzero(t.owned & (t.code != 0)), 1)
            if tally.add(lang, np.concatenate([words, np.zeros((1, 1), np.uint64)]), np.append(times, times.sum())):
                yield tally.blocks()
        yield tally.blocks()

    return summed(chunks_.mapInArrow(run, BLOCK_DDL), parts, 1, lambda rows, counts: (counts >= least) | (rows[:, 0] == 0))


def phrase_counts(chunks_: DataFrame, n: int, parts: int, least: int, known: Broadcast) -> DataFrame:
    """lang, phrase and f of every frequent phrase of n words whose two parts of n - 1 words are marked in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(parts)
        for lang, t in buffered(batches):
            hit, whole = t.marked(known.value, n - 1), t.whole(n)
            at = np.flatnonzero(hit[:-1] & hit[1:] & whole & t.owned[: len(whole)]) if len(whole) else whole
            if len(at) and tally.add(lang, *t.counted(at, n)):
                yield tally.blocks()
        yield tally.blocks()

    return summed(chunks_.mapInArrow(run, BLOCK_DDL), parts, n, lambda rows, counts: counts >= least)


def runs_of(chunks_: DataFrame, n: int, known: Broadcast) -> DataFrame:
    """The parts of the chunks in which every phrase of n words may be frequent, if they are longer than n; equal ones added up.

    No longer phrase can be frequent anywhere else, so the later levels read these alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, t in buffered(batches):
            hit = t.marked(known.value, n).astype(np.int8)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
            first, last = edges[0::2], edges[1::2] + n - 1
            starts = np.concatenate([[0], np.cumsum(t.owned)])
            owned = starts[last] - starts[first]
            kept = np.flatnonzero((last - first > n) & (owned > 0))
            raw, seen = t.code.tobytes(), {}
            times = t.times[t.row[first[kept]]].tolist() if len(kept) else []
            for a, z, own, f in zip((first[kept] * CODE).tolist(), (last[kept] * CODE).tolist(), owned[kept].tolist(), times, strict=True):
                key = raw[a:z], own
                seen[key] = seen.get(key, 0) + f
            yield batch_of([(lang, chunk, own, f) for (chunk, own), f in seen.items()], CHUNK)

    return chunks_.mapInArrow(run, CHUNK_DDL).groupBy("lang", "chunk", "owned").agg(F.sum("n").alias("n"))


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def slots(hashes: np.ndarray, langs: np.ndarray | np.uint64, bits: int) -> np.ndarray:
    return mixed(hashes ^ langs) >> np.uint64(64 - bits)


def probed(bitmap: np.ndarray, hashes: np.ndarray, langs: np.ndarray | np.uint64) -> np.ndarray:
    at = slots(hashes, langs, (len(bitmap) * 64).bit_length() - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(phrases: DataFrame, n: int, count: int) -> np.ndarray:
    """Bits of the phrases (lang, phrase) of n words, in 64-bit cells; the cells are combined in the cluster."""
    bits = min(max(LEAST_BITS, (BITS_EACH * count).bit_length()), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, n)
            langs = b.column(0).to_pylist()
            hashes = {lang: lang_hash(lang) for lang in set(langs)}
            at = slots(phrase_hashes(list(rows.T)), np.array([hashes[lang] for lang in langs], np.uint64), bits)
            values = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(values.view(np.int64))], names=["cell", "bits"])

    cells = phrases.select("lang", "phrase").mapInArrow(run, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out


def dictionary(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct chunks (stored), and the vocabulary: code and word. Codes that two words share are changed."""
    seed = 0
    while True:
        table = written(parsed(docs, window, seed), "chunks")
        words = table.filter(F.col("owned") == VOCABULARY).select(F.expr(f"substring(chunk, 1, {CODE})").alias("code"), F.expr(f"substring(chunk, {CODE + 1})").cast("string").alias("word"))
        if words.groupBy("code").count().filter("count > 1").isEmpty():
            return table, words
        dropped(table)
        seed += 1


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to ``longest`` words found ``least`` times or more, (lang, n) with the number of words, and the vocabulary."""
    spark, window = docs.sparkSession, max(1, longest - 1)
    table, vocabulary = dictionary(docs, window)
    chunks_ = table.filter(F.col("owned") != VOCABULARY)
    parts = max(LEAST_PARTS, chunks_.count() * PERIOD // PART_WORDS)
    words = written(word_counts(chunks_, parts, least), "chunk-words")
    none = F.lit(bytes(CODE))
    totals = words.filter(F.col("phrase") == none).select("lang", F.col("f").alias("n"))
    levels, spent = [words.filter((F.col("phrase") != none) & (F.col("f") >= least))], []
    for n in range(2, longest + 1):
        count = levels[-1].count()
        if not count:
            break
        known = spark.sparkContext.broadcast(bitmap_of(levels[-1], n - 1, count))
        if n > 2:
            # only what is left after the pairs goes through the longer levels
            chunks_ = written(runs_of(chunks_, n - 1, known), f"runs-{n - 1}")
            spent.append(chunks_)
        levels.append(written(phrase_counts(chunks_, n, parts, least, known), f"phrases-{n}"))
        known.unpersist()
    for runs in spent:
        dropped(runs)
    out = levels[0].withColumn("words", F.lit(1))
    for n, level in enumerate(levels[1:], 2):
        out = out.union(level.withColumn("words", F.lit(n)))
    return out.select("lang", "phrase", "words", "f"), totals, vocabulary


def scored(phrases: DataFrame, totals: DataFrame, scale: int = 1000) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every phrase of two words or more, at its lowest-scoring cut (ties: the earliest).

    The score is floor(scale * a * n / (l * r)), in whole decimal numbers of up to 38 digits.
    """
    sums = phrases.select("lang", "phrase", "f")
    cuts = phrases.filter("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"_first": F.expr(f"substring(phrase, 1, {CODE} * k)"), "_rest": F.expr(f"substring(phrase, {CODE} * k + 1)")}).withColumnRenamed("f", "a")
    cuts = attach(cuts, sums.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"])
    cuts = attach(cuts, sums.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
    cuts = attach(cuts, totals, ["lang"])
    whole = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.withColumn("_above", whole["a"] * whole["n"] * F.lit(scale).cast("decimal(6,0)")).withColumn("_below", whole["l"] * whole["r"])
    cuts = cuts.withColumn("score", F.expr("_above div _below"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("_best"))
    return best.select("lang", "phrase", "words", "a", *[f"_best.{c}" for c in ("l", "r", "n", "score")])


def uncovered(rows: DataFrame, cover: int = 100) -> DataFrame:
    """``rows`` (lang, phrase, words, a) without those that stand in a longer one with 100 * f(longer) >= cover * a."""
    inside = f"transform(sequence(0, words - k), i -> substring(phrase, {CODE} * i + 1, {CODE} * k))"
    inner = rows.filter("words > 2").select("lang", F.col("a").alias("_longer"), F.explode(F.expr(f"flatten(transform(sequence(2, words - 1), k -> {inside}))")).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    out = attach(rows, most, ["lang", "phrase"])
    return out.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < cover * F.col("a"))).drop("_longer")


def spelled(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``rows`` (phrase, words) with the phrase's words, joined by spaces, instead of their codes."""
    each = rows.select("phrase", "words").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.col("words") - 1)))
    each = attach(each.withColumn("code", F.expr(f"substring(phrase, {CODE} * i + 1, {CODE})")), vocabulary, ["code"])
    texts = each.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("_text"))
    return attach(rows, texts, ["phrase"]).withColumn("phrase", F.col("_text")).drop("_text")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000, cover: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases by score, then count, then phrase."""
    phrases, totals, vocabulary = frequent_phrases(docs, least, longest)
    rows = spelled(uncovered(scored(phrases, totals), cover), vocabulary)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of every part first, so that no language is ranked whole in one task
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKS)))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= best)
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
