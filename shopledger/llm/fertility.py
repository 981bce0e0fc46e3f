"""Quality rules: tokeniser fertility of every document, with rejection bands per language.

A public vocabulary is trained on ordinary text, so ordinary text costs it few tokens. Per document this measures
code points per token, the share of byte-fallback tokens, and the entropy of the tokens (divided by the log2 of
their number). Bands come from the distinct texts that pass the base rules. Per language, the centre of a measure follows the
length: medians by powers of two of the tokens, neighbours merged until ``LEAST_TEXTS`` texts set each, and between them a line in
1 / log2(tokens); beyond the longest the entropy's bits stay as they are. The width is ``reach`` median absolute deviations over all lengths at once, after each deviation is multiplied by
the root of its tokens, as short texts scatter more. A language of fewer texts is judged by its script, a rare script by all texts; a table
of fewer distinct texts has no bands. A document outside a band is rejected, and so is one that fails the fixed base rules.

Null, empty and white-space texts have no words, hence zeros, a failed base and no measures. Languages are compared
by their code; anything that is no code of two or three letters (null included) counts as ``und``, so there are at
most 18,279 codes and 40 lengths. Repeated rows are judged one by one. Other columns pass through ``judged`` untouched; the
measures are in one struct column whose name the caller picks, so names cannot clash.
"""

from __future__ import annotations

import functools
import math
import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, written

#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Band width in deviations (median absolute ones, scaled to a normal law's), and distinct texts that set a centre at least.
REACH, NORMAL, LEAST_TEXTS = 4.5, 1.4826, 50
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: Least half width of a band, where a language's documents agree almost entirely.
LEAST_WIDTH = {"chars_per_token": 0.05, "byte_share": 0.03, "token_entropy": 0.02}
#: Columns of the verdicts.
BASE_FAILED, KEPT = "__fertility_base_failed", "__fertility_kept"
FACTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, text_hash long, script int"
)
_SPACES = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
#: First bytes of UTF-8 letters by script: Latin, Greek, Cyrillic, Armenian and Hebrew, Arabic, Indic and Thai, other of E1, kana, Han, Hangul, above U+FFFF.
_SCRIPTS = [[*range(65, 91), *range(97, 123), *range(0xC3, 0xCC)], [0xCE, 0xCF], range(0xD0, 0xD5), range(0xD5, 0xD8), range(0xD8, 0xDC), [0xE0], [0xE1], [0xE3], range(0xE4, 0xEA), range(0xEA, 0xEE), range(0xF0, 0xF5)]
_OF_SCRIPT = np.array([[b in s for b in range(256)] for s in _SCRIPTS], np.int64)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = np.zeros(n, bool)
    equal = mixed[order[1:]] == mixed[order[:-1]]
    if not equal.any():
        return 0
    same[order[1:]] |= equal
    same[order[:-1]] |= equal
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(same)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Meter:
    """Measures texts; one per worker."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.words = WordTable(self.encode)

    def encode(self, word: bytes) -> tuple[int, bytes]:
        """A number for the word and its tokens as bytes."""
        return xxhash.xxh64_intdigest(word), struct.pack(f"{len(ids := self.model.encode(word.decode()))}H", *ids)

    def measure(self, texts: list[str | None]) -> list[tuple]:
        raw = ((t or "").encode("utf-8") for t in texts)
        return [self.one(r, r.split()) for r in raw]

    def one(self, raw: bytes, words: list[bytes]) -> tuple:
        byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        chars = len(raw) - int(byte[128:192].sum()) - int(byte[_SPACES].sum())
        lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        base = (len(words), chars, int(byte[_SYMBOLS].sum()), len(lines) - len(set(lines)))
        told = (xxhash.xxh64_intdigest(raw) - 2**63, int((_OF_SCRIPT @ byte).argmax()))
        if not words:
            return (*base, 0, 0, None, None, None, *told)
        found = [self.words[w] for w in words]
        ids = np.fromiter((f[0] for f in found), np.uint64, len(found))
        tokens = np.frombuffer(b"".join([f[1] for f in found]), np.uint16)
        counts = np.bincount(tokens, minlength=self.size)
        some = counts[counts > 0] / len(tokens)
        entropy = float(-(some * np.log2(some)).sum()) / max(1.0, math.log2(max(2, len(tokens))))
        return (*base, repeated_words(ids), len(tokens), chars / len(tokens), float(counts[self.is_byte].sum()) / len(tokens), entropy, *told)


@functools.lru_cache(maxsize=2)
def meter(model_path: str) -> Meter:
    return Meter(model_path)


def facts(text: Column, model_path: str) -> Column:
    """A struct of FACTS per text; ``model_path`` is the vocabulary's file on every machine."""

    @F.pandas_udf(FACTS)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(meter(model_path).measure(texts.tolist()), columns=[x.split()[0] for x in FACTS.split(", ")]).astype(dict.fromkeys(MEASURES, "float64"))

    return measured(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEAT_PERCENT * n_words)


def language(lang: Column) -> Column:
    """A code of two or three letters, or ``und``: a closed set."""
    code = F.lower(F.trim(lang))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise(F.lit("und"))


def length_class(n_tokens: Column) -> Column:
    """The power of two at or below the number of tokens."""
    return F.floor(F.log2(F.greatest(n_tokens, F.lit(1)))).cast("int")


def shortness(n_tokens: Column) -> Column:
    """1 / log2 of the tokens: what a text's entropy depends on almost as a line, bounded for every length."""
    return 1 / F.log2(F.greatest(n_tokens, F.lit(2)))


def groups(classes: dict[int, int], least: int = LEAST_TEXTS) -> dict[int, int]:
    """Length class to group: neighbouring classes (length: texts) are merged until each group has ``least`` texts."""
    out, sizes = {}, [0]
    for length in sorted(classes):
        if sizes[-1] >= least:
            sizes.append(0)
        sizes[-1] += classes[length]
        out[length] = len(sizes) - 1
    if len(sizes) > 1 and sizes[-1] < least:
        out = {length: min(k, len(sizes) - 2) for length, k in out.items()}
    return out


def knots(of_group: dict[int, int], medians: dict[int, dict]) -> list[tuple]:
    """Per length class 0 to 62: shortness, then centre and slope of each measure, from the
    groups' ``medians`` (shortness, MEASURES). Slopes are those between a group's neighbours; beyond the middle of the longest group the
    bits of entropy stay as they are, as a language's words run out, and the other measures too."""
    out, last = [], max(of_group.values())
    for length in range(63):
        k = next((of_group[n] for n in sorted(of_group) if n >= length), last)
        here, low, high = medians[k], medians[max(0, k - 1)], medians[min(last, k + 1)]
        step = high["shortness"] - low["shortness"]
        beyond = not step or (k == last and 1 / here["shortness"] < length + 0.5)
        slope = {m: (here[m] / here["shortness"] if m == "token_entropy" else 0.0) if beyond else (high[m] - low[m]) / step for m in MEASURES}
        out.append((length, here["shortness"], *[v for m in MEASURES for v in (here[m], slope[m])]))
    return out


def bands(rows: DataFrame, facts_column: str, lang: str = "lang") -> DataFrame:
    """Per cell (language, script or all) and length: shortness, and centre, slope and deviation of each measure. The distinct texts that
    pass the base rules are stored and read three times: sizes, centres, deviations. Medians are merged from partial sketches."""
    spark = rows.sparkSession
    f = lambda n: F.col(f"`{facts_column}`.`{n}`")
    passed = rows.filter(~base_failed(f("n_words"), f("n_repeat_words")))
    texts = passed.select(language(F.col(lang)).alias("code"), *[f(n).alias(n) for n in ("script", "text_hash", "n_tokens", *MEASURES)]).dropDuplicates(["code", "text_hash"])
    # a text counts for its language, its script and all
    cells = written(texts, "fertility-texts").withColumns({"length": length_class(F.col("n_tokens")), "shortness": shortness(F.col("n_tokens"))})
    cells = cells.withColumn("cell", F.explode(F.array("code", F.col("script").cast("string"), F.lit("all texts"))))
    median = lambda c, n: F.percentile_approx(c, 0.5, 10_000).alias(n)
    # closed sets of codes, scripts and lengths: at most 18,291 * 63 rows
    sizes: dict[str, dict[int, int]] = {}
    for r in cells.groupBy("cell", "length").count().collect():
        sizes.setdefault(r.cell, {})[r.length] = r["count"]
    of_group = {cell: groups(classes) for cell, classes in sorted(sizes.items()) if sum(classes.values()) >= LEAST_TEXTS}
    grouped = spark.createDataFrame([(cell, length, k) for cell, of in of_group.items() for length, k in of.items()], "cell string, length int, group int")
    medians: dict[str, dict[int, dict]] = {}
    for r in cells.join(F.broadcast(grouped), ["cell", "length"]).groupBy("cell", "group").agg(*[median(F.col(n), n) for n in ("shortness", *MEASURES)]).collect():
        medians.setdefault(r.cell, {})[r.group] = r.asDict()
    lines = [(cell, *k) for cell, of in of_group.items() for k in knots(of, medians[cell])]
    names = [f"{m} {part}" for m in MEASURES for part in ("centre", "slope")]
    centres = spark.createDataFrame(lines, "cell string, length int, at double, " + ", ".join(f"`{n}` double" for n in names))
    off = cells.join(F.broadcast(centres), ["cell", "length"])
    spread = off.groupBy("cell").agg(*[median(F.abs(F.col(m) - _centre(m, F.col("shortness"))) * F.sqrt("n_tokens"), f"{m} deviation") for m in MEASURES])
    return centres.join(F.broadcast(spread), "cell")


def _centre(measure: str, at: Column) -> Column:
    return F.col(f"`{measure} centre`") + F.col(f"`{measure} slope`") * (at - F.col("at"))


def judged(rows: DataFrame, facts_column: str, lang: str = "lang", reach: float = REACH) -> DataFrame:
    """``rows`` with BASE_FAILED and KEPT. ``rows`` must be stored: it is read for the bands and again for the verdicts."""
    limits = {(r.cell, r.length): r for r in bands(rows, facts_column, lang).collect()}
    known = {cell for cell, _ in limits}
    names = ["at", *[f"{m} {part}" for m in MEASURES for part in ("centre", "slope", "deviation")]]
    table = rows.sparkSession.createDataFrame([(*k, tuple(float(r[n]) for n in names)) for k, r in limits.items()], "__fertility_cell string, __fertility_length int, __fertility_limits struct<" + ", ".join(f"`{n}`: double" for n in names) + ">")
    codes = rows.sparkSession.createDataFrame([(c, c) for c in sorted(known) if c.isalpha()], "__fertility_code string, __fertility_own string")
    f = {n: F.col(f"`{facts_column}`.`{n}`") for n in ("n_words", "n_repeat_words", "n_tokens", "script", *MEASURES)}
    limit = lambda n: F.col(f"__fertility_limits.`{n}`")
    script = f["script"].cast("string")
    cell = F.coalesce("__fertility_own", F.when(script.isin(sorted(c for c in known if c.isdigit())), script), F.lit("all texts"))
    keyed = rows.withColumn("__fertility_code", language(F.col(lang))).join(F.broadcast(codes), "__fertility_code", "left")
    keyed = keyed.withColumns({"__fertility_cell": cell, "__fertility_length": length_class(f["n_tokens"])})
    joined = keyed.join(F.broadcast(table), ["__fertility_cell", "__fertility_length"], "left")
    inside = F.lit(True)
    for m in MEASURES:
        centre = limit(f"{m} centre") + limit(f"{m} slope") * (shortness(f["n_tokens"]) - limit("at"))
        room = F.greatest(F.lit(reach * NORMAL) * limit(f"{m} deviation") / F.sqrt(F.greatest(f["n_tokens"], F.lit(1))), F.lit(LEAST_WIDTH[m]))
        inside = inside & F.coalesce(F.abs(f[m] - centre) <= room, F.lit(False))
    failed = base_failed(f["n_words"], f["n_repeat_words"])
    # a table too small for any band judges by the base rules alone
    kept = ~failed & (F.col("__fertility_limits").isNull() | inside)
    return joined.withColumn(BASE_FAILED, failed).withColumn(KEPT, kept).drop(*[c for c in joined.columns if c.startswith("__fertility_") and c not in rows.columns])
