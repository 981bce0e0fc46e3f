"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

``encode`` gives each text the piece sequence of the largest score sum. The automaton reads the text once; at every
position its output links name all pieces that end there, longest first, and each relaxes the best score of that
position. Of equal sums the one whose last piece is longest wins, position by position. A character that no piece
covers becomes its UTF-8 bytes, at a score below that of every piece. Scores are summed exactly, in double.

Texts are cut where no piece can cross (before a space mark, and around line feeds) and equal cuts are segmented
once per worker; a vocabulary with pieces that cross such a place is not cut there.

Null and empty texts give an empty list; ``decode`` of null is null, of an empty list an empty text. ``decode`` returns the text that was encoded, but
for texts that hold the space mark U+2581 itself, which the format turns into a space. Only models with identity
normalisation, a dummy prefix, byte fallback and white space kept are accepted; any other raises an error.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable

MARK = "▁"
#: Fixed value of the format: an uncovered character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0


def loaded(model_path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    return model


@functools.lru_cache(maxsize=2)
def piece_bytes(model_path: str) -> list[bytes]:
    """What each id decodes to; all that decoding needs."""
    return [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in loaded(model_path).pieces]


def decoded(ids: list[int], pieces: list[bytes]) -> str:
    raw = b"".join(map(pieces.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", errors="replace")


class Pieces:
    """The vocabulary as an automaton, with the place of each byte piece."""

    def __init__(self, model_path: str):
        import ahocorasick

        model = loaded(model_path)
        norm, trained = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with a dummy prefix and byte fallback is supported")
        plain = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (1, 4)]
        self.automaton = ahocorasick.Automaton()
        for i, piece, score in plain:
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for _, p, _ in plain if len(p) == 1}
        self.unknown_score = min(s for _, _, s in plain) - UNKNOWN_PENALTY
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.cut_marks = not any(MARK in p.lstrip(MARK) for _, p, _ in plain)
        self.cut_lines = not any("\n" in p for _, p, _ in plain)
        self.line_feed = np.array([self.byte[10]], "<i4").tobytes() if 10 in self.byte else b""

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of an escaped text."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        unknown = [i for i, c in enumerate(text) if c not in self.single]
        waiting, at = iter([*unknown, n]), 0
        at = next(waiting)
        for end, (piece, length, score) in self.automaton.iter(text) if n else ():
            while at < end:  # uncovered characters that end before this position
                if (known := best[at]) is not None and (best[at + 1] is None or known + self.unknown_score > best[at + 1]):
                    best[at + 1], back[at + 1] = known + self.unknown_score, (-1, 1)
                at = next(waiting)
            if (known := best[end + 1 - length]) is not None and (best[end + 1] is None or known + score > best[end + 1]):
                best[end + 1], back[end + 1] = known + score, (piece, length)
        while at < n:
            if (known := best[at]) is not None and (best[at + 1] is None or known + self.unknown_score > best[at + 1]):
                best[at + 1], back[at + 1] = known + self.unknown_score, (-1, 1)
            at = next(waiting)
        ids: list[int] = []
        while n:
            piece, length = back[n]
            n -= length
            ids += [piece] if piece >= 0 else [self.byte[b] for b in reversed(text[n].encode())]
        return ids[::-1]

    def encode(self, chunk: str) -> bytes:
        return np.array(self.segment(chunk), "<i4").tobytes()


class Codec:
    """Encodes lists of texts; one per worker."""

    def __init__(self, model_path: str):
        self.pieces = Pieces(model_path)
        self.table = WordTable(self.pieces.encode)

    def chunks(self, text: str) -> list[str]:
        """Parts of the escaped text between which no piece spans; line feeds stand alone."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        parts = text.split("\n") if self.pieces.cut_lines and self.pieces.line_feed else [text]
        out: list[str] = []
        for k, p in enumerate(parts):
            if k:
                out.append("\n")
            if not self.pieces.cut_marks:
                out.append(p)
            elif MARK * 2 in p:
                out += re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", p)
            else:
                first, *rest = p.split(MARK)
                out += [first, *[MARK + r for r in rest]] if first else [MARK + r for r in rest]
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for t in texts:
            yield b"".join([self.table[c] for c in self.chunks(t or "")])


@functools.lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def _lists(raw: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(x) // 4 for x in raw]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, n_chars: code points of the text, restored: whether the decoded ids are the text), a row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                texts = b.column(1).to_pylist()
                raw, pieces = list(codec(model_path).encode(texts)), piece_bytes(model_path)
                restored = [decoded(np.frombuffer(x, "<i4").tolist(), pieces) == (t or "") for x, t in zip(raw, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(raw), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(restored)], names=[key, "ids", "n_chars", "restored"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_chars long, restored boolean")


def decode(rows: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the decoded text in ``out``."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        pieces = piece_bytes(model_path)
        return pd.Series([None if x is None else decoded(x.tolist(), pieces) for x in lists], dtype=object)

    return rows.withColumn(out, run(ids))
