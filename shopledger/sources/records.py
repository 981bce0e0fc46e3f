"""CSV with quoted line breaks, read in ranges.

Spark splits the files at line feeds; a range's lines stay in one task and in order. Whether a line begins inside a quoted field depends on all lines
before it, so the first pass works out for every range how it ends if it begins outside, and if it begins inside a field. These two
answers are followed range by range per file, which names the ranges that begin inside a field. The second pass reads each range's records; what
precedes its first record and follows its last whole one are fragments, at most two a range, and only these are brought
together and joined across ranges.

A file of n ranges is n tasks in both passes, and a task holds one record at a time. Rows end in ``\\n`` or ``\\r\\n``; a quote inside an unquoted field is an ordinary character.
Text behind a closing quote, a quoted field that never ends, undecodable bytes, another header and a row of another width fail the read.
Empty lines are skipped.
"""

from __future__ import annotations

import codecs
import csv
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTSIDE, INSIDE, WRONG = 0, 1, 2
#: Ranges known to begin inside a field that are sent to all tasks; beyond, lines are joined to them.
SENT = 100_000
#: Records parsed and returned at a time.
BATCH = 5_000
_QUOTED = re.compile(r'(?:[^"]++|"")*+')
_BLOCK = ("file", "start")


class Fields:
    """Follows the quotes of a line; ``sep`` is one character."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        self.sep = sep
        self.whole = re.compile(rf'(?:(?:"(?:[^"]++|"")*+"|[^"{s}][^{s}]*+|){s})*+')

    def after(self, line: str, state: int) -> int:
        """Where a line ends that begins in ``state``."""
        if '"' not in line or state == WRONG:
            return state
        at = 0
        if state == INSIDE:
            at = _QUOTED.match(line).end()
            if at == len(line):
                return INSIDE
            if not line.startswith(self.sep, at + 1):
                return OUTSIDE if line[at + 1 :] in ("", "\r") else WRONG
            at += 2
        at = self.whole.match(line, at).end()
        if not line.startswith('"', at):
            return OUTSIDE
        end = _QUOTED.match(line, at + 1).end()
        if end == len(line):
            return INSIDE
        return OUTSIDE if line[end + 1 :] in ("", "\r") else WRONG


def lines_of(spark: SparkSession, path) -> DataFrame:
    """line (bytes), file and start of its range; a range's lines follow each other."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def decoded(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[tuple[str, int, bool, str, int | None]]:
    """file, start, whether the line is its file's first, text and given state of every line."""
    known, plain = None, "utf-8" if encoding == "utf-8-sig" else encoding
    for b in batches:
        states = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
        for raw, file, start, state in zip(*[c.to_pylist() for c in b.columns[:3]], states, strict=True):
            first = start == 0 and (file, start) != known
            known = file, start
            if first and encoding == "utf-8-sig" and raw.startswith(codecs.BOM_UTF8):
                raw = raw[len(codecs.BOM_UTF8) :]
            yield file, start, first, raw.decode(plain), state


def range_ends(lines: DataFrame, encoding: str, sep: str) -> DataFrame:
    """file, start and how the range ends after beginning outside, and inside, a quoted field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, block, ends, out = Fields(sep), None, [], []
        for file, start, _, line, _ in decoded(batches, encoding):
            if (file, start) != block:
                out += [(*block, *ends)] if block else []
                block, ends = (file, start), [OUTSIDE, INSIDE]
            if '"' in line:
                ends = [fields.after(line, s) for s in ends]
        out += [(*block, *ends)] if block else []
        yield table(out, (pa.string(), pa.int64(), pa.int32(), pa.int32()), (*_BLOCK, "outside", "inside"))

    return lines.mapInArrow(run, "file string, start long, outside int, inside int")


def table(rows: list[tuple], types: Sequence[pa.DataType], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))


def range_starts(ends: DataFrame) -> DataFrame:
    """file, start of the ranges that begin inside a quoted field, followed through each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state = None, OUTSIDE
        for b in batches:
            out = []
            for name, start, outside, inside in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if name != file:
                    ended(file, state)
                    file, state = name, OUTSIDE
                if state == INSIDE:
                    out.append((name, start))
                state = (outside, inside, WRONG)[state]
            yield table(out, (pa.string(), pa.int64()), _BLOCK)
        ended(file, state)

    return ends.repartition("file").sortWithinPartitions(*_BLOCK).mapInArrow(run, "file string, start long")


def ended(file: str | None, state: int) -> None:
    if state != OUTSIDE:
        raise ValueError(f"quotes do not match in {file}")


def parsed(records: list[str], sep: str, columns: Sequence[str]) -> list[list[str]]:
    """Cells of whole records; empty lines are skipped."""
    rows = [r for r in csv.reader(records, delimiter=sep, strict=True) if r]
    for r in rows:
        if len(r) != len(columns):
            raise ValueError(f"a row has {len(r)} cells instead of {len(columns)}")
    return rows


def checked(record: str, sep: str, columns: Sequence[str]) -> None:
    header = next(csv.reader([record], delimiter=sep, strict=True), [])
    if [h.strip() for h in header] != list(columns):
        raise ValueError(f"the header is {header}")


def range_records(lines: DataFrame, encoding: str, sep: str, columns: Sequence[str], inside) -> DataFrame:
    """The cells of whole records, and fragments (file, start, place, text) in rows without cells.

    Place 0 is what precedes a range's first record (null text: nothing, the range begins a record), 1 what its last, unfinished record has so
    far. A range without any record's end gives place 0 only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = Fields(sep)
        block, state, held, head, header = None, OUTSIDE, [], False, False
        records: list[str] = []
        pieces: list[tuple] = []

        def close() -> None:
            if block and (head or held):
                pieces.append((*block, 0 if head else 1, "\n".join(held), not head))

        def flush() -> pa.RecordBatch:
            cells = parsed(records, sep, columns)
            n, m = len(cells), len(pieces)
            columns_ = [pa.array([r[k] for r in cells] + [None] * m, pa.string()) for k in range(len(columns))]
            parts = [pa.array([None] * n + [p[k] for p in pieces], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()))]
            records.clear()
            pieces.clear()
            return pa.RecordBatch.from_arrays([*parts, *columns_], names=names)

        for file, start, first, line, given in decoded(batches, encoding):
            if (file, start) != block:
                close()
                block, held, header = (file, start), [], first
                state = (INSIDE if (file, start) in inside.value else OUTSIDE) if given is None else given
                head = state == INSIDE
            state = fields.after(line, state)
            if state == WRONG:
                raise ValueError(f"text behind a closing quote in {file}")
            held.append(line)
            if state == INSIDE:
                continue
            record, held = "\n".join(held), []
            if head:
                pieces.append((*block, 0, record, True))
                head = False
            elif header:
                checked(record, sep, columns)
                header = False
            else:
                records.append(record)
            if len(records) + len(pieces) >= BATCH:
                yield flush()
        close()
        yield flush()

    names = ["_file", "_start", "_place", "_text", "_ends", *[f"c{k}" for k in range(len(columns))]]
    return lines.mapInArrow(run, "_file string, _start long, _place int, _text string, _ends boolean, " + ", ".join(f"c{k} string" for k in range(len(columns))))


def stitched(pieces: DataFrame, sep: str, columns: Sequence[str]) -> DataFrame:
    """The cells of records that cross ranges, joined in the order of their file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for b in batches:
            records = []
            for place, text, ends, start in zip(*[b.column(c).to_pylist() for c in ("_place", "_text", "_ends", "_start")], strict=True):
                held.append(text)
                if place == 0 and ends:
                    record, held = "\n".join(held), []
                    records.append((start, record))
            cells = parsed([r for _, r in records], sep, columns)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in cells], pa.string()) for k in range(len(columns))], names=[f"c{k}" for k in range(len(columns))])

    ordered = pieces.repartition("_file").sortWithinPartitions("_file", "_start", "_place")
    return ordered.mapInArrow(run, ", ".join(f"c{k} string" for k in range(len(columns))))


def read_records(spark: SparkSession, path, columns: Sequence[str], encoding: str, sep: str) -> DataFrame:
    """All rows of the files, cells as text; the passes over the quotes run at once, the records are read lazily."""
    lines = lines_of(spark, path)
    starts = range_starts(range_ends(lines, encoding, sep))
    found = starts.limit(SENT + 1).collect()
    inside = spark.sparkContext.broadcast({(r.file, r.start) for r in found[:SENT]})
    if len(found) > SENT:
        states = starts.withColumn("state", F.lit(INSIDE))
        placed = lines.withColumn("_at", F.monotonically_increasing_id()).join(states, list(_BLOCK), "left")
        ordered = placed.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "_at")
        lines = ordered.select("line", *_BLOCK, F.coalesce("state", F.lit(OUTSIDE)).alias("state"))
    read = range_records(lines, encoding, sep, columns, inside)
    cells = [f"c{k}" for k in range(len(columns))]
    whole = read.filter("_file is null").select(*cells)
    crossing = stitched(read.filter("_file is not null").select("_file", "_start", "_place", "_text", "_ends"), sep, columns)
    return whole.unionByName(crossing).toDF(*columns)
