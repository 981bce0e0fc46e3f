r"""Conversation structure repair by Four-Russians block tables.

A conversation's rows become symbols: the role's initial (s, u, a or another), whether the row must go (blank or duplicate) and whether it is truncated. Its
cheapest edits into role initials ``(s?(ua)+)?`` follow from the cost still to pay at each position in each of four states (nothing
yet, after s, after u, after a). These cost vectors, less their least entry, are few; so for every vector and every block of ``BLOCK`` symbols
the vector in front of the block and what it costs more are computed once, and a conversation is swept from its end to its start by one
lookup a block. The trace runs forward: each block is expanded backward from its end vector, and at each position the
first edit in ASCII order (Delete, Insert, Keep, Rerole) that stays on a cheapest path is taken, so ties give the least string of initials.
The state after an edit is decided by its initial, therefore no two traces give the same string.

Rows are ranked by range partitions. Symbols travel in segments of ``SEGMENT`` rows; tasks go through a conversation's segments one after
the other, with a vector or a state as their only memory, and its texts pass through the digest in the same way. So a conversation that holds a
large share of all rows costs one task no more memory than a segment, though its digest must read its texts in order.

Null roles and texts are one space, null ids and turns are one space in the damage key. Turns are ordered with nulls first, ties by role and
text. A null conv_id is one conversation. A kept row's role is given as it is; an initial other than s, u, a is never legal. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.spread import attach
from .common import ranked, written
from .linededup import WHITE, hashed

#: Costs of the edits, and what a truncated row adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols of a block, and rows of a segment (a multiple of it).
BLOCK, SEGMENT = 4, 4096
#: States: nothing yet, after s, after u, after a. Per state the state behind the only u or a that may follow, and that letter.
STATES, AFTER, LETTER = 4, (2, 2, 3, 2), "uuau"
#: Cost to go at the end: nothing, u and a, a, nothing.
END = (0, 2 * INSERT, INSERT, 0)
#: Initials in the order of their symbols; symbol 0 must be deleted, 1 + 2 * initial is whole, 2 + 2 * initial truncated.
INITIALS, SYMBOLS = "sua?", 9
KEY = ["_null", "_conv"]


def kept_state(state: int, initial: str) -> int | None:
    """Where a kept row leads, if its initial may follow."""
    if initial == "s":
        return 1 if state == 0 else None
    return AFTER[state] if initial == LETTER[state] else None


def stepped(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to go in front of a symbol, from those behind it."""
    costs, more = [DELETE + c for c in after], TRUNCATED * (symbol % 2 == 0)
    if symbol:
        initial = INITIALS[(symbol - 1) // 2]
        for q in range(STATES):
            kept = kept_state(q, initial)
            costs[q] = min(costs[q], REROLE + more + after[AFTER[q]], costs[q] if kept is None else more + after[kept])
    u, a = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return min(costs[0], INSERT + u), min(costs[1], INSERT + u), u, a


@functools.cache
def vectors() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All normalised cost vectors (the end's first), and for (vector, symbol) the vector in front and what it costs more."""
    found, index, steps = [END], {END: 0}, []
    for v in found:
        steps.append([])
        for x in range(SYMBOLS):
            raw = stepped(v, x)
            least = min(raw)
            normal = tuple(c - least for c in raw)
            if normal not in index:
                index[normal] = len(found)
                found.append(normal)
            steps[-1].append((index[normal], least))
    table = np.array(steps, np.int32)
    return found, table[:, :, 0], table[:, :, 1]


@functools.cache
def blocks() -> tuple[np.ndarray, np.ndarray]:
    """The same for (vector, block), a block's code being its symbols as digits, the first one highest."""
    _, ahead, cost = vectors()
    to, paid = ahead, cost
    for _ in range(BLOCK - 1):
        # one symbol more in front: all codes of the longer block, first symbol by first symbol
        to, paid = (
            np.concatenate([ahead[to, x] for x in range(SYMBOLS)], axis=1),
            np.concatenate([paid + cost[to, x] for x in range(SYMBOLS)], axis=1),
        )
    return to, paid


def block_codes(symbols: bytes) -> np.ndarray:
    """Codes of the blocks of a segment; its first symbols, if fewer than a block, stay out."""
    digits = np.frombuffer(symbols, np.uint8)[len(symbols) % BLOCK :].astype(np.int64).reshape(-1, BLOCK)
    return digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def swept(symbols: bytes, vector: int) -> tuple[int, int]:
    """The vector in front of a segment and what the segment costs more, from the vector behind it."""
    to, paid = blocks()
    total = 0
    for code in block_codes(symbols)[::-1].tolist():
        total += int(paid[vector, code])
        vector = int(to[vector, code])
    _, ahead, cost = vectors()
    for x in symbols[: len(symbols) % BLOCK][::-1]:
        total += int(cost[vector, x])
        vector = int(ahead[vector, x])
    return vector, total


@functools.lru_cache(maxsize=1 << 17)
def expanded(symbols: bytes, vector: int, state: int) -> tuple[tuple[str, ...], int]:
    """Edits of a block (a code per symbol) and the state behind it, entered in ``state``, with ``vector`` behind it.

    A code is the letters inserted before the row (u, a), then D, K, or the letter of the new role (U, A).
    """
    found, *_ = vectors()
    costs = [found[vector]]
    for x in reversed(symbols):
        costs.append(stepped(costs[-1], x))
    costs.reverse()
    codes = []
    for x, here, behind in zip(symbols, costs, costs[1:], strict=False):
        code, more = "", TRUNCATED * (x % 2 == 0)
        initial = INITIALS[(x - 1) // 2] if x else ""
        while True:
            kept = kept_state(state, initial) if x else None
            if here[state] == DELETE + behind[state]:
                code += "D"
            elif here[state] == INSERT + here[AFTER[state]]:
                code, state = code + LETTER[state], AFTER[state]
                continue
            elif kept is not None and here[state] == more + behind[kept]:
                code, state = code + "K", kept
            else:
                code, state = code + LETTER[state].upper(), AFTER[state]
            break
        codes.append(code)
    return tuple(codes), state


def traced(symbols: bytes, vector: int, state: int) -> tuple[list[str], int]:
    """Edits of a segment and the state behind it, entered in ``state``, with ``vector`` behind it."""
    to, _ = blocks()
    behind = [vector]
    for code in block_codes(symbols)[:0:-1].tolist():
        behind.append(int(to[behind[-1], code]))
    first = len(symbols) % BLOCK
    ends = list(range(first + BLOCK, len(symbols) + 1, BLOCK))
    out: list[str] = []
    if first:
        front = int(to[behind[-1], block_codes(symbols)[0]]) if ends else vector
        codes, state = expanded(symbols[:first], front, state)
        out += codes
    for end, v in zip(ends, reversed(behind), strict=False):
        codes, state = expanded(symbols[end - BLOCK : end], v, state)
        out += codes
    return out, state


def closing(state: int) -> str:
    """Letters inserted behind the last row."""
    return {0: "", 1: "ua", 2: "a", 3: ""}[state]


def audit(codes: list[str]) -> str:
    """Initials of the edits."""
    return "".join(codes).translate(str.maketrans("uaUA", "IIRR"))


def spelled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """_null, _conv, turn, role, text after the damage that crc32 of ``conv_id:turn`` decides."""
    rows = turns.select(
        F.col("conv_id").isNull().alias("_null"), F.coalesce("conv_id", F.lit(0)).alias("_conv"), "turn", spelled("role").alias("role"), spelled("text").alias("text"),
        (F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20).alias("_d"),
    ).filter("_d != 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(*KEY, "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_d")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_d", "_copy")


def judged(rows: DataFrame) -> DataFrame:
    """Ranked rows with their first fault and their symbol; stored, as several steps read them."""
    placed = ranked(rows.select(*KEY, "turn", "role", "text", *hashed(F.struct("role", "text"), ["_t1", "_t2"])), KEY, ["turn", "role", "text"], "repair-turns")
    first = placed.groupBy(*KEY, "_t1", "_t2").agg(F.min("_rank").alias("_first"))
    body = F.btrim(F.col("text"), F.lit(WHITE))
    fault = (
        F.when(body == "", "blank").when(F.col("_rank") > F.col("_first"), "duplicate")
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * number + F.when(F.col("fault") == "truncated", 1).otherwise(0))
    known = attach(placed, first, [*KEY, "_t1", "_t2"]).withColumn("fault", fault)
    out = known.select(*KEY, F.col("_rank").alias("at"), "turn", "role", "text", "fault", symbol.cast("int").alias("symbol"), number.alias("initial"))
    return written(out, "repair-rows")


def segments(rows: DataFrame) -> DataFrame:
    """Segments of ``SEGMENT`` rows: _null, _conv, seg, symbols and initials (one byte a row, in order)."""
    numbered = rows.select(*KEY, F.expr(f"(at - 1) div {SEGMENT}").alias("seg"), F.struct("at", "symbol", "initial").alias("_row"))
    lists = numbered.groupBy(*KEY, "seg").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))

    def packed(digits: Column) -> Column:
        return F.unhex(F.array_join(F.transform(digits, lambda d: F.concat(F.lit("0"), d.cast("string"))), ""))

    return lists.select(*KEY, "seg", packed(F.col("_rows.symbol")).alias("symbols"), packed(F.col("_rows.initial")).alias("initials"))


def widened(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def in_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Every conversation's rows in one task and in order, as a stream."""
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, *order)


def backward(parts: DataFrame) -> DataFrame:
    """Segments with ``vector`` (behind them) and ``cost``; a conversation's first segment has its whole cost, others null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, *_ = vectors()
        conv, vector, total = None, 0, 0
        for b in batches:
            ends, costs = [], []
            for row in b.select([*KEY, "seg", "symbols"]).to_pylist():
                if (row["_null"], row["_conv"]) != conv:
                    conv, vector, total = (row["_null"], row["_conv"]), 0, 0
                ends.append(vector)
                vector, paid = swept(row["symbols"], vector)
                total += paid
                costs.append(total + found[vector][0] if row["seg"] == 0 else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.int32()), pa.array(costs, pa.int64())], names=[*b.schema.names, "vector", "cost"])

    return in_order(parts, F.col("seg").desc()).mapInArrow(run, widened(parts.schema, "vector int, cost long"))


def forward(parts: DataFrame) -> DataFrame:
    """_null, _conv, seg, cost, codes (an edit code per row), tail (letters inserted at the end) and illegal (wrong neighbours up to here)."""
    schema = widened(parts.select(*KEY, "seg", "cost").schema, "codes array<string>, tail string, illegal long, audit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, before, legal = None, 0, -1, {(0, 1), (1, 2), (2, 1)}
        for b in batches:
            out = []
            for row in b.to_pylist():
                if (row["_null"], row["_conv"]) != conv:
                    conv, state, before = (row["_null"], row["_conv"]), 0, -1
                initials = row["initials"]
                pairs = zip([before, *initials], initials, strict=False)
                wrong = sum(p not in legal for p in pairs if p[0] >= 0)
                before = initials[-1]
                codes, state = traced(row["symbols"], row["vector"], state)
                # only the last segment ends in the end vector's state; elsewhere the next segment goes on
                tail = closing(state) if row["last"] else ""
                out.append((codes, tail, wrong, audit([*codes, tail])))
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.list_(pa.string()), pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*KEY, "seg", "cost")], *columns], names=[*KEY, "seg", "cost", "codes", "tail", "illegal", "audit"])

    return in_order(parts, "seg").mapInArrow(run, schema)


def digested(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """_null, _conv, repaired_sha256: of the repaired ``role:text`` lines, fed in order.

    A segment's codes come first and its rows follow, so a task holds one segment's codes and one batch of texts.
    """
    heads = edits.select(*KEY, "seg", F.lit(0).cast("long").alias("at"), "codes", "tail", F.lit("").alias("role"), F.lit("").alias("text"))
    seg = F.expr(f"(at - 1) div {SEGMENT}").alias("seg")
    bodies = rows.select(*KEY, seg, "at", F.lit(None).cast("array<string>").alias("codes"), F.lit(None).cast("string").alias("tail"), "role", "text")
    names = {"u": "user", "a": "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, codes, tail, digest, some = None, [], "", hashlib.sha256(), False

        def tell(line: str) -> None:
            nonlocal some
            digest.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
            some = True

        def close() -> tuple:
            for letter in tail:
                tell(names[letter] + ":")
            return *conv, digest.hexdigest()

        for b in batches:
            out = []
            for null, key, _, at, listed, ending, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (null, key) != conv:
                    if conv is not None:
                        out.append(close())
                    conv, digest, some = (null, key), hashlib.sha256(), False
                if at == 0:
                    codes, tail = iter(listed), ending
                    continue
                code = next(codes)
                for letter in code[:-1]:
                    tell(names[letter] + ":")
                if code[-1] != "D":
                    tell((role if code[-1] == "K" else names[code[-1].lower()]) + ":" + text)
            yield answer(out)
        if conv is not None:
            yield answer([close()])

    def answer(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.bool_(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=[*KEY, "repaired_sha256"])

    return in_order(heads.unionByName(bodies), "seg", "at").mapInArrow(run, "_null boolean, _conv long, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after ``damaged``."""
    named = turns.select("conv_id", F.col("conv_id").isNull().alias("_null"), F.coalesce("conv_id", F.lit(0)).alias("_conv")).distinct()
    rows = judged(damaged(turns))
    faults = [F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).alias(f) for f in ("blank", "duplicate", "truncated")]
    # distinct turns first, so that both steps add up on the map side
    per_turn = rows.groupBy(*KEY, "turn").agg(*faults, F.count(F.lit(1)).alias("_n"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    facts = per_turn.groupBy(*KEY).agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")], F.sum("_n").alias("_n"))
    parts = attach(backward(segments(rows)), facts.select(*KEY, F.expr(f"(_n - 1) div {SEGMENT}").alias("_last")), KEY)
    edits = written(forward(parts.withColumn("last", F.col("seg") == F.col("_last")).drop("_last")), "repair-edits")
    told = edits.groupBy(*KEY).agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("seg", "audit"))).alias("_audits"))
    told = told.withColumn("audit", F.array_join(F.col("_audits.audit"), "")).drop("_audits")
    out = named.join(facts, KEY, "left").join(told, KEY, "left").join(digested(rows, edits), KEY, "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
