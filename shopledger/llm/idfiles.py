"""Token-id files: one zstd frame per document, one dictionary for all of them, an offset index per file.

A file holds the frames of one range of doc ids, in ascending order (null first, ties by id bytes):

    frames | index | footer

The index has four little-endian arrays (doc id int64, null flag uint8, end offset of the frame uint64, number of
ids uint32); the footer is the number of documents, the index's length, and the SHA-256 of the dictionary.
Reading one short document costs the index and one frame. ``manifest`` (a Parquet table beside the files) lists
the files in order with their counts, so that the position of any document in the whole stream is known.

Texts are split at spaces and line feeds before encoding: the vocabulary's pattern never lets a token span white
space, so words are encoded once and kept, as many as fit a table. A vocabulary that does not give the same ids for probing texts in this way is
run over whole texts.

Null or empty texts encode to the end id alone. Repeated rows are written as often as they occur. Other columns
are not read. An empty table gives no file and an empty manifest. Tasks write to a name of their own and then
rename, so a task that runs twice leaves one file with the same bytes.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordTable, fresh_path

FOOTER = "<QQ32s"
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long, dictionary string"
#: Documents the dictionary is trained on at most (those of the smallest hash), and its size; both are parameters below. Of a longer document
#: that many ids are taken, from a place its hash decides.
TRAINING_ROWS, DICTIONARY_BYTES, TRAINING_IDS = 2_000, 64 << 10, 8_192
#: Words and parts of words that a worker keeps.
KEPT_WORDS = 300_000
#: Symbols that end a word are one piece to the vocabulary's pattern. Apostrophes and the signs of control tokens are not among them.
SYMBOLS = ".,!?;:#$%&*()\"-/@+=[]{}~^_`\\"
PROBES = ("Hello, World's 12.5 caf\u00e9!! na\u00efve\n\n x.y $$$ a$b&&& it's... I'LL (see) [1] don't-stop, \u6f22\u5b57 \u00df\u0130, 3rd%%%", "", "  two  spaces ", "end<|endoftext|>!! a_b__ -- \u2026")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for a byte: itself if printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """text -> little-endian uint32 ids as bytes, with the end id; for lists of texts. One per worker.

    The library's pipeline is run word by word. Symbols behind a letter are a piece of their own for the
    vocabulary's pattern; a word of composed Latin letters alone is one piece to it, which its model encodes directly.
    """

    def __init__(self, tokenizer_path: str, end_id: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.cores, self.words = WordTable(self.encode_core, limit=KEPT_WORDS), WordTable(self.encode_word, limit=KEPT_WORDS)
        self.by_word = all(self.joined(t) == self.whole(t) for t in PROBES)

    def encode_core(self, w: str) -> bytes:
        if w.isascii() and w.isalpha():
            ids = [t.id for t in self.model.tokenize(w.lower())]
        elif w.isalpha() and max(w) <= "\u017f" and not set(w) & {"\u0130", "\u0149", "\u017f"}:
            ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in w.lower().encode()]))]
        else:
            ids = self.tokenizer.encode(w, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_word(self, w: str) -> bytes:
        core = w.rstrip(SYMBOLS)
        if not core[-1:].lower().isalpha():
            return self.encode_core(w)
        known = self.cores[core.lower() if core.isascii() else core]
        return known if len(core) == len(w) else known + self.cores[w[len(core) :]]

    def joined(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        encode = self.joined if self.by_word else self.whole
        for t in texts:
            yield encode(t or "") + self.end


@functools.lru_cache(maxsize=2)
def word_encoder(tokenizer_path: str, end_id: int) -> WordEncoder:
    return WordEncoder(tokenizer_path, end_id)


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, rows: int = TRAINING_ROWS, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from serialized id arrays of at most ``rows`` documents, encoded in tasks; empty if they are too few to train on.

    A document longer than TRAINING_IDS gives that many ids, from a place its hash decides. Only the compression depends on this; what is written is whole.
    """
    import zstandard

    drawn = F.xxhash64(F.lit("dictionary"), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, most = word_encoder(tokenizer_path, end_id), 4 * TRAINING_IDS
        for b in batches:
            out = []
            for h, ids in zip(b.column(0).to_pylist(), run(b.column(1).to_pylist()), strict=True):
                start = 4 * (h % max(1, (len(ids) - most) // 4 + 1)) if len(ids) > most else 0
                out.append(ids[start : start + most])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["h", "ids"])

    # hashes alone are sorted; the texts of the smallest follow in a second step
    most = docs.select(drawn.alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("h")).first().h
    if most is None:
        return b""
    chosen = docs.filter(drawn <= most).select(drawn.alias("h"), "text").mapInArrow(encode, "h long, ids binary")
    samples = [r.ids for r in chosen.orderBy("h", "ids").limit(rows).collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _tools(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, rows_per_file: int = 20_000) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text) below ``folder``; returns the manifest, with ``start`` per file."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n = docs.count()
    files = max(1, math.ceil(n / rows_per_file))
    cuts: list[int] = []
    if files > 1:
        at = F.percentile_approx("doc_id", [k / files for k in range(1, files)], 20 * files)
        cuts = sorted(set(docs.agg(at.alias("at")).first().at or []))
    dictionary = spark.sparkContext.broadcast(train_dictionary(docs, tokenizer_path, end_id))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, (pack, _), bounds = word_encoder(tokenizer_path, end_id), _tools(dictionary.value), np.array(cuts, dtype=np.int64)
        for b in batches:
            ids = list(run(b.column(1).to_pylist()))
            keys = b.column(0)
            shard = np.searchsorted(bounds, np.asarray(keys.fill_null(-(1 << 63))), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([pack.compress(x) for x in ids], pa.binary())],
                names=["shard", "doc_id", "n_tokens", "crc", "frame"],
            )

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = open_folder(folder)
        open_file = None

        def close() -> pd.DataFrame:
            out, name, held = open_file["out"], open_file["name"], open_file["index"]
            keys, nulls, ends, counts = (np.concatenate([h[k] for h in held]) for k in range(4))
            index = keys.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + ends.astype("<u8").tobytes() + counts.astype("<u4").tobytes()
            out.write(index + struct.pack(FOOTER, len(keys), len(index), hashlib.sha256(dictionary.value).digest()))
            out.close()
            store.move(f"{name}.{open_file['mark']}", name)
            return pd.DataFrame([{"shard": open_file["shard"], "path": name, "n_docs": len(keys), "n_tokens": int(counts.sum()), "n_bytes": int(ends[-1]), "dictionary": hashlib.sha256(dictionary.value).hexdigest()}])

        for p in parts:
            for shard, rows in p.groupby("shard", sort=False):
                if open_file and open_file["shard"] != shard:
                    yield close()
                    open_file = None
                if not open_file:
                    name, mark = f"{top}/ids-{shard:06d}.bin", uuid.uuid4().hex
                    open_file = {"shard": int(shard), "name": name, "mark": mark, "out": store.open_output_stream(f"{name}.{mark}"), "index": [], "end": 0}
                ends = open_file["end"] + np.cumsum([len(f) for f in rows["frame"]])
                open_file["out"].write(b"".join(rows["frame"]))
                open_file["end"] = int(ends[-1])
                open_file["index"].append((rows["doc_id"].fillna(0).to_numpy(np.int64), rows["doc_id"].isna().to_numpy(), ends, rows["n_tokens"].to_numpy()))
        if open_file:
            yield close()

    store, top = open_folder(folder)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/dictionary.zdict") as f:
        f.write(dictionary.value)
    encoded = docs.mapInArrow(encode, "shard int, doc_id long, n_tokens long, crc long, frame binary")
    # each file belongs to one task; a task keeps no more than one batch and the index of the open file
    placed = encoded.repartitionById(files, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "crc").drop("crc")
    placed.mapInPandas(put, MANIFEST).write.parquet(f"{folder}/manifest")
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row a file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_bytes (little-endian uint32)."""

    def get(parts: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        with store.open_input_stream(f"{top}/dictionary.zdict") as f:
            dictionary = f.read()
        _, unpack = _tools(dictionary)
        for p in parts:
            for path, start in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    keys, nulls, ends, counts = read_index(f, dictionary)
                    f.seek(0)
                    starts = start + np.cumsum(counts) - counts
                    for first in range(0, len(keys), 512):
                        part = slice(first, min(first + 512, len(keys)))
                        base = int(ends[first - 1]) if first else 0
                        raw = f.read(int(ends[part.stop - 1]) - base)
                        cut = [0, *(int(e) - base for e in ends[part])]
                        ids = [unpack.decompress(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[part], mask=nulls[part].astype(bool)), pa.array(starts[part].astype(np.int64)), pa.array(counts[part].astype(np.int64)), pa.array(ids, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids_bytes"],
                        )

    files = manifest.select("path", "start").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism))
    return files.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_bytes binary")


def read_index(f, dictionary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The offset index of an open file; a dictionary other than the one it was written with is an error."""
    size = f.size()
    f.seek(size - struct.calcsize(FOOTER))
    n, length, digest = struct.unpack(FOOTER, f.read(struct.calcsize(FOOTER)))
    if digest != hashlib.sha256(dictionary).digest():
        raise ValueError("the file was written with another dictionary")
    f.seek(size - struct.calcsize(FOOTER) - length)
    raw = f.read(length)
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n), np.frombuffer(raw, "<u8", n, 9 * n), np.frombuffer(raw, "<u4", n, 17 * n)


def read_one(path: str, folder: str, position: int) -> np.ndarray:
    """The ids of one document, by its position in a file."""
    store, top = open_folder(folder)
    with store.open_input_stream(f"{top}/dictionary.zdict") as f:
        dictionary = f.read()
    with store.open_input_file(path) as f:
        _, _, ends, _ = read_index(f, dictionary)
        begin = int(ends[position - 1]) if position else 0
        f.seek(begin)
        return np.frombuffer(_tools(dictionary)[1].decompress(f.read(int(ends[position]) - begin)), "<u4")


def written_ids(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all documents to fresh files and read them back."""
    folder = fresh_path(spark, "token-ids")
    return read(write(docs, folder, tokenizer_path, end_id), folder)
