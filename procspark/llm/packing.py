"""Best-fit packing of token pieces into sequences under several capacities.

A piece demands tokens, a document slot and attention cost (its length squared). All three follow from its length, so
pieces of one length are alike and only the number of pieces per length matters for the plan: a table of at most
``tokens`` numbers, whatever the corpus. From it the driver builds sequences one pattern at a time. The next piece
is the one that fits every residual capacity and has the best weighted dot product with the residual vector, or leaves the
smallest weighted residual norm. A pattern is repeated as often as the counts allow, so there are few
patterns even for very many sequences. Each piece then finds its own place from its rank among the pieces of its length;
ranks come from counts per slice, not from a window over all pieces of a length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procspark.llm.common import only, raw
from procspark.session import cut

_KNOWN_WORDS = 400_000  # words whose ids a worker remembers, beside those of the text at hand


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence. By default only tokens bind: no more documents or cost fit into the tokens anyway."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)
    rule: str = "norm"  # or "dot"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# letters that this tokenizer keeps together and lower-cases one by one, and marks that it keeps together
_LETTERS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_MARKS = b".,;:!?"


class _Encoder(dict):
    """Ids of words as little-endian unsigned 32-bit numbers; a worker keeps one and what it has learnt.

    This tokenizer drops white space and never joins across it, so a text's ids are its words' ids end to end. Most words are
    letters and closing marks: there the letters, in lower case, are one piece for the vocabulary's merges and the marks another.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tok = _tokenizer(path)
        self.merge = self.tok.model.tokenize
        self.stems: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}
        from tokenizers.pre_tokenizers import ByteLevel

        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = {c: shown(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}  # lower-case letters beyond ASCII
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.tok.get_vocab().values()) + 1)]

    def _encode(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tok.encode(text, add_special_tokens=False).ids])

    def _stem(self, stem: bytes, text: str) -> bytes:
        ids = self.stems[stem] = b"".join([self.packed[t.id] for t in self.merge(text)])
        return ids

    def __missing__(self, w: bytes) -> bytes:
        letters = w.rstrip(_MARKS)
        tail = w[len(letters):]
        if tail and tail not in self.tails:
            self.tails[tail] = self._encode(tail.decode())
        if letters.isalpha():  # ASCII letters only
            stem = letters.lower()
            ids = (self.stems.get(stem) or self._stem(stem, stem.decode())) + self.tails[tail]
        else:
            text = letters.decode()
            if _LETTERS.fullmatch(text):
                text = text.lower()
                stem = text.encode()
                ids = (self.stems.get(stem) or self._stem(stem, text.translate(self.shown))) + self.tails[tail]
            else:
                ids = self._encode(w.decode())
        self[w] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        for learnt in (self, self.stems, self.tails):
            if len(learnt) > _KNOWN_WORDS:
                learnt.clear()
                self.tails[b""] = b""
        return b"".join(map(self.__getitem__, text.split()))


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 4096, end: int = 1) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` and ``slice_no, place``: the task, and the rank among its pieces of that length.

    Null text is empty: only the end id. Repeated rows are separate documents. Nothing is shuffled.
    """
    source = only(docs, id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        seen = np.zeros(tokens + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            row, piece, start, length, crc, place = [], [], [], [], [], []
            for i, text in enumerate(raw(batch, text_col)):
                view = memoryview(encoder.ids(text) + last)
                for k, at in enumerate(range(0, len(view), 4 * tokens)):
                    bit = view[at:at + 4 * tokens]
                    n = len(bit) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(bit))
                    place.append(int(seen[n]))
                    seen[n] += 1
            if row:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(place, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32", "slice_no", "place"])

    return source.mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, slice_no int, place bigint")


def plan(counts: dict[int, int], limits: Limits = Limits()) -> np.ndarray:
    """Rows ``length, first rank, copies in a sequence, first sequence, offset of the first copy``, sorted by length and rank.

    ``counts``: pieces per length. Every length must fit an empty sequence.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    left = np.array([counts[n] for n in lengths.tolist()], dtype=np.int64)
    demand = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1)
    size = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.int64)
    if (demand > size).any():
        raise ValueError("a piece exceeds the capacities of an empty sequence")
    share, weight = demand / size, np.array(limits.weights)
    rank = np.zeros_like(left)
    rows, base = [], 0
    while len(left) and left.any():
        residual, spare, used, offset = size.copy(), left.copy(), {}, 0
        while True:
            fits = np.flatnonzero((spare > 0) & (demand <= residual).all(axis=1))
            if not len(fits):
                break
            rest = residual / size
            if limits.rule == "dot":
                best = fits[np.argmax((share[fits] * rest * weight).sum(axis=1))]
            else:
                best = fits[np.argmin((((rest - share[fits]) ** 2) * weight).sum(axis=1))]
            # the same piece stays the best choice for as long as it fits: both scores grow with its size
            n = int(min(spare[best], (residual // demand[best]).min()))
            used[int(best)] = (n, offset)
            offset += n * int(lengths[best])
            residual -= n * demand[best]
            spare[best] = 0
        times = min(int(left[k]) // n for k, (n, _) in used.items())
        for k, (n, at) in used.items():
            rows.append((int(lengths[k]), int(rank[k]), n, base, at))
            rank[k] += n * times
            left[k] -= n * times
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


_RANKS = 1 << 44


def pack(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every row keeps its place in exactly one sequence, without gaps.

    ``pieces`` must have ``length, slice_no, place`` as from :func:`tokenize`. It is written to the shared folder first,
    so that a recomputed task can't deal other ranks. An empty table gives an empty result.
    """
    names = [c for c in pieces.columns if c not in ("slice_no", "place")]
    kept = cut(pieces)
    per_slice = kept.groupBy("length", "slice_no").agg(F.count("*").alias("n"))
    per_slice = cut(per_slice)
    counts = {r["length"]: r["n"] for r in per_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `tokens` rows
    table = plan(counts, limits)
    earlier = Window.partitionBy("length").orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slice.select("length", "slice_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = kept.join(before, ["length", "slice_no"]).select(*names, (F.col("before") + F.col("place")).alias("rank"))
    key = table[:, 0] * _RANKS + table[:, 1]
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(key, length * _RANKS + rank, side="right") - 1]
            past = rank - row[:, 1]
            cols = [batch.column(n) for n in names]
            cols += [pa.array(row[:, 3] + past // row[:, 2]), pa.array(row[:, 4] + past % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)
