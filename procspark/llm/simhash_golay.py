"""SimHash near-duplicates, joined on Golay-code keys.

Fingerprints of 64 bits are cut into three segments of at most 23 bits. The binary Golay code [23, 12, 7] is perfect: each
23-bit word lies within three bits of exactly one codeword. The keys of a segment are all codewords within four
bits: one, or six if the nearest is three away. Of two segments that differ in at most one bit, the nearest codeword
of the one is within four bits of the other, so they share a key. If two fingerprints differ in at most three bits, at
least two of their three segments differ in at most one bit each; so they share a pair of keys in one of three tables.

Equal fingerprints are one row before any key is made. Within a key only a spanning forest of the verified links is
kept, never all pairs; keys that many fingerprints share are dealt into tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procspark.llm.common import arrow_map, only, raw
from procspark.operators.components import connected_components
from procspark.session import cut, lookup

DISTANCE = 3
TILE = 4096
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_SHIFTS, _WIDTHS = (41, 18, 0), (23, 23, 18)
_HASHES_AT_ONCE = 1 << 16


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of these hashes have each of the 64 bits set."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # counts of a byte, then of a word
        ones += bits[at:at + 255].sum(axis=0, dtype=np.uint8)
    return ones


def fingerprint_of(h: np.ndarray) -> int:
    """The fingerprint of shingles that are given as unsigned 64-bit hashes; none: zero."""
    ones = sum((_ones(h[lo:lo + _HASHES_AT_ONCE]) for lo in range(0, len(h), _HASHES_AT_ONCE)), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Lower-case A-Z; a bit is 1 if set in over half the shingles' hashes, repeats included; no words: zero."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    n = len(parts) - words + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _HASHES_AT_ONCE):
        hi = min(n, lo + _HASHES_AT_ONCE)
        ones += _ones(np.array([digest(joined[a:b - 1], seed) for a, b in zip(starts[lo:hi], starts[lo + words:hi + words])], dtype=np.uint64))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``id, fp`` (the fingerprint as a signed 64-bit number), one row per row; null text counts as empty."""
    source = only(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words, seed) for t in raw(batch, text_col)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    return arrow_map(source, run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, fp bigint")


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, _GENERATOR << (bit - 11), 0)
    return v


class Golay:
    """``near[s]``: the error patterns of at most four bits with syndrome ``s``, nearest first; ``many[s]``: 1 or 6 of them."""

    def __init__(self):
        one = [1 << b for b in range(23)]
        patterns = [0]
        level = [0]
        for _ in range(4):
            level = [p | b for p in level for b in one if b > p]
            patterns += level
        patterns = np.array(patterns, dtype=np.int64)
        syndrome = _remainder(patterns)
        weight = np.bitwise_count(patterns)
        order = np.lexsort((patterns, weight, syndrome))
        first = np.searchsorted(syndrome[order], np.arange(2048))
        counts = np.bincount(syndrome, minlength=2048)
        self.many = counts
        self.near = np.zeros((2048, counts.max()), np.int64)
        for k in range(counts.max()):
            has = counts > k
            self.near[has, k] = patterns[order][first[has] + k]
        self.low = _remainder(np.arange(1 << 12, dtype=np.int64))
        self.high = _remainder(np.arange(1 << 11, dtype=np.int64) << 12)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword indices (12 bits) near each 23-bit word as a table with one row per word, and which cells are in use."""
        s = self.low[words & 0xFFF] ^ self.high[words >> 12]
        # the upper 12 bits of a codeword of this cyclic code determine it
        return (words[:, None] ^ self.near[s]) >> 11, np.arange(self.near.shape[1]) < self.many[s][:, None]


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of every pair of segment keys of these unsigned fingerprints."""
    code = golay()
    segments = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(_SHIFTS, _WIDTHS)]
    found = [code.keys(s) for s in segments]
    rows, keys = [], []
    for table, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ka, ua), (kb, ub) = found[a], found[b]
        both = (ka[:, :, None] << 12 | kb[:, None, :]) | table << 24
        row, i, j = np.nonzero(ua[:, :, None] & ub[:, None, :])
        rows.append(row)
        keys.append(both[row, i, j])
    return np.concatenate(rows), np.concatenate(keys)


def forest(fp: np.ndarray, distance: int = DISTANCE) -> tuple[list[int], list[int]]:
    """Links that connect what ``distance`` connects among these fingerprints, without cycles."""
    left = fp
    src, dst = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            close = np.bitwise_count(left ^ u) <= distance
            if close.any():
                new = left[close]
                left = left[~close]
                src += [int(u)] * len(new)
                dst += new.tolist()
                queue += list(new)
    return src, dst


def _links_of_groups(key: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    src, dst = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for size in np.unique(sizes).tolist():
        if size == 1:
            continue
        at = starts[sizes == size]
        if size <= 6:  # all groups of one size together
            m = fp[at[:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            close = np.bitwise_count(m[:, i] ^ m[:, j]) <= distance
            g, p = np.nonzero(close)
            src.append(m[g, i[p]])
            dst.append(m[g, j[p]])
        else:
            for s in at.tolist():
                u, v = forest(fp[s:s + size], distance)
                src.append(np.array(u, np.uint64))
                dst.append(np.array(v, np.uint64))
    a, b = np.concatenate(src), np.concatenate(dst)
    a, b = np.minimum(a, b), np.maximum(a, b)
    pair = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
    return pair[:, 0], pair[:, 1]


_ROWS = 200_000


def _links(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole keys are judged together, some hundred thousand rows at a time."""

    def judged(key, fp):
        a, b = _links_of_groups(key, fp, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

    keys, fps, held = [], [], 0
    for batch in batches:
        keys.append(batch.column(0).to_numpy())
        fps.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= _ROWS:
            key, fp = np.concatenate(keys), np.concatenate(fps).view(np.uint64)
            cut_at = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut_at:
                yield judged(key[:cut_at], fp[:cut_at])
            keys, fps, held = [key[cut_at:]], [fp[cut_at:].view(np.int64)], len(key) - cut_at
    if held:
        yield judged(np.concatenate(keys), np.concatenate(fps).view(np.uint64))


def links(distinct: DataFrame, tile: int = TILE, distance: int = DISTANCE) -> DataFrame:
    """``src, dst``: links between different fingerprints that connect exactly what three bits connect. With a larger ``distance`` they connect,
    beyond that, fingerprints up to it that share a key."""
    spark = distinct.sparkSession

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy()
        row, key = keys_of(fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    keyed = arrow_map(distinct.select("fp"), run, "key bigint, fp bigint")
    hot = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile))
    if not hot.isEmpty():
        # a hot key's rows go into tiles; every pair of tiles, and each tile with itself, is one group
        tiles = hot.select("key", F.ceil(2 * F.col("n") / tile).cast("int").alias("tiles"))
        mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        dealt = keyed.join(lookup(tiles), "key", "left").select("key", "fp", "tiles", mine.alias("a"))
        split = dealt.filter("tiles is not null").select("key", "fp", "a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("b"))
        split = split.select(F.xxhash64("key", F.least("a", "b"), F.greatest("a", "b")).alias("key"), "fp")
        keyed = dealt.filter("tiles is null").select("key", "fp").unionByName(split)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(width, "key").sortWithinPartitions("key").mapInArrow(lambda batches: _links(batches, distance), "src bigint, dst bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint, component_id``: one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of three bits or fewer; texts without words have fingerprint zero
    and link like any other. Null ids are reachable and pass links on, but never name a component (it is null where
    nothing else is reachable). Repeated rows come out as often as they come in.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    member = connected_components(links(distinct)).select(F.col("node").alias("fp"), F.col("component"))
    placed = distinct.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    placed = cut(placed)
    named = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = placed.select("fp", "component").join(named, "component").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(by_print, "fp").select(id_col, shown.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component, one for each group, with all columns.

    Rows with a null id can't be named and stay. Of rows that share an id, one stays.
    """
    return keep_named(docs, near_duplicates(docs, id_col, text_col), id_col)


def keep_named(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """``keep_first`` for components that are given as ``id, component_id``."""
    found = found.select(F.col(id_col).alias("id*"), "component_id").filter(F.col("`id*`").isNotNull())
    by_id = cut(found.groupBy("`id*`").agg(F.max(F.col("`id*`") == F.col("component_id")).alias("stays"), F.count("*").alias("n")))
    # only ids travel: sent to the texts while they are few, else joined
    gone = lookup(by_id.filter(~F.col("stays")).select("`id*`"))
    kept = docs.join(gone, docs[id_col] == gone["`id*`"], "left_anti")
    if by_id.filter("n > 1").isEmpty():
        return kept
    named = F.col(f"`{id_col}`").isNotNull()
    return kept.filter(named).dropDuplicates([id_col]).unionByName(kept.filter(~named))
