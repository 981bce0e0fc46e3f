"""Skew-safe joins, first-copy marks and ordered statistics.

A single key may hold a large share of all rows. Aggregations combine on the map side, so they are
safe as they are; a join back to the rows and a row_number() per key are not. The helpers here keep
such a key on many tasks and stay exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIEVE_BITS = 26


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join one-row-per-key facts to rows so that a hot key can be split at run time.

    Facts usually come from an aggregation by the same keys, whose layout the join would reuse; adaptive
    execution can then not split a skewed partition. The extra key (always 0) makes both sides pass an
    exchange of their own: the smaller one, and the one that adaptive skew handling needs.
    """
    apart = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    left = rows.withColumn("_apart", apart)
    right = facts.withColumn("_apart", apart)
    return left.join(right, [*keys, "_apart"], "left").drop("_apart")


def row_text(columns: Sequence[str]) -> Column:
    """The columns as one text; null differs from every text."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns])


def row_print(columns: Sequence[str]) -> Column:
    """SHA-256 over the columns; null differs from every text."""
    return F.sha2(row_text(columns), 256)


def mark_repeats(rows: DataFrame, identity: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Flag every copy of a row but the first by ``order`` (a unique key of the rows).

    Prints with copies and their first key come from one aggregation that combines on the map side; this small table meets the
    rows once, so a print of any size stays on many tasks.
    """
    key = F.struct(*[F.col(c) for c in order])
    marked = rows.withColumn("_print", row_print(identity))
    twice = (
        marked.groupBy("_print").agg(F.count(F.lit(1)).alias("_copies"), F.min(key).alias("_first"))
        .filter(F.col("_copies") > 1).select("_print", "_first")
    )
    joined = attach(marked, twice, ["_print"])
    return joined.withColumn(name, F.coalesce(key != F.col("_first"), F.lit(False))).drop("_print", "_first")


def _words(hashes: DataFrame) -> DataFrame:
    spot = F.pmod("_hash", F.lit(1 << SIEVE_BITS))
    words = hashes.select(F.shiftright(spot, 6).alias("_word"), (spot % 64).cast("int").alias("_spot"))
    return words.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _spot)")).alias("_bits"))


def sieve(keys: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Which of 2**SIEVE_BITS hashes the keys have, 64 to a row: at most a million short rows, however many keys there are."""
    return _words(keys.select(F.xxhash64(*parts).alias("_hash")))


def repeated(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """A sieve of the keys that more than one row has; only hashes travel."""
    hashes = rows.select(F.xxhash64(*parts).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    return _words(hashes.filter("_n > 1"))


def sifted(rows: DataFrame, words: DataFrame, parts: Sequence[str], name: str) -> DataFrame:
    """The rows with ``name``: false only where their key is surely not in the sieve. The rows stay where they are."""
    spot = F.pmod(F.xxhash64(*parts), F.lit(1 << SIEVE_BITS))
    met = rows.withColumns({"_word": F.shiftright(spot, 6), "_spot": (spot % 64).cast("int")}).join(F.broadcast(words), "_word", "left")
    return met.withColumn(name, F.coalesce(F.getbit("_bits", F.col("_spot")) == 1, F.lit(False))).drop("_word", "_spot", "_bits")


def value_bucket(c: Column) -> Column:
    """Order-preserving bucket of a number: 0.1 % wide, at most some 140,000 different buckets."""
    v = c.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * 1000).cast("int")


def totals_above(
    rows: DataFrame, value: str, measures: dict[str, Column], groups: Sequence[str] = (), ascending: bool = False
) -> DataFrame:
    """Per distinct value, each measure's sum and its running sum over strictly larger values.

    One row per (groups, value) with ``<m>``, ``<m>_before`` and the group's ``<m>_total``. Buckets are summed first (their number
    is bounded, see value_bucket), so no task ever orders the whole table.
    """
    names = list(measures)
    direction = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    ties = rows.groupBy(*groups, value).agg(*[m.alias(n) for n, m in measures.items()])
    ties = ties.withColumn("_bucket", value_bucket(F.col(value)))
    ahead = Window.partitionBy(*groups).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = ties.groupBy(*groups, "_bucket").agg(*[F.sum(n).alias(n) for n in names])
    whole = Window.partitionBy(*groups)
    offsets = buckets.select(
        *groups,
        "_bucket",
        *[F.sum(n).over(ahead).alias("_o_" + n) for n in names],
        *[F.sum(n).over(whole).alias(n + "_total") for n in names],
    )
    inside = (
        Window.partitionBy(*groups, "_bucket").orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, -1)
    )
    within = ties.select("*", *[F.sum(n).over(inside).alias("_i_" + n) for n in names])
    joined = within.join(offsets, [*groups, "_bucket"])
    zero = F.lit(0)
    return joined.select(
        *groups,
        value,
        *names,
        *[(F.coalesce("_o_" + n, zero) + F.coalesce("_i_" + n, zero)).alias(n + "_before") for n in names],
        *[n + "_total" for n in names],
    )


def exact_quantiles(
    rows: DataFrame, value: str, probabilities: dict[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolation quantiles per group without holding a group in one task."""
    counts = totals_above(rows.filter(F.col(value).isNotNull()), value, {"n": F.count(F.lit(1))}, groups, ascending=True)
    picks = []
    for name, p in probabilities.items():
        position = (F.col("n_total") - 1) * F.lit(p)
        for tag, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{tag}"))
    found = counts.groupBy(*groups).agg(F.max("n_total").alias("_size"), *picks)
    columns = []
    for name, p in probabilities.items():
        position = (F.col("_size") - 1) * F.lit(p)
        share = position - F.floor(position)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((low + (high - low) * share).alias(name))
    return found.select(*groups, *columns)


def any_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result
