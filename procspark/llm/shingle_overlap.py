"""Near copies: SimHash fingerprints of word shingles on Golay keys, checked by exact Jaccard similarity, and a join on prefixes of the sorted
sets for the pairs whose fingerprints lie too far apart.

Every set has a fingerprint of 64 bits. Sets with one fingerprint, and fingerprints that share a Golay key and differ in ``NEAR_BITS`` or less, are
candidates (``simhash_golay.links``); the sets decide. A similarity of 0.8 often leaves more bits apart than keys reach, so the joins below follow.

Shingles are 64-bit hashes in one global order: the rarest first, by a table of counts of fixed size over the shingles of all texts
(tasks count, tables are added), equal counts by hash. If two sets have a
similarity of at least t, the first |x| - ceil(t |x|) + 1 of the one and of the other have a shingle in common (Bayardo et
al., 2007), so no pair is missed, whatever the counts. Counts are never too low: a shingle counted once stands in one text and is no key. Texts that
share a passage and little else don't meet, since the passage stands last in both.

Pairs that meet under a key are kept if their sizes, the key's places in both sets (Xiao et al., 2008) and bitmaps allow t (a bit is the parity of the
shingles that fall on it; bits that differ are at most the shingles that differ); what is left is decided on the sets. Sets are
not stored: they are made again from the texts, for verification from those of possible pairs alone.

Equal sets are one row. After the fingerprints a first pass takes a few shingles of each set, the smallest hashes, and decides a spanning forest of the possible pairs of
a key; it links most copies. The second takes whole prefixes, of these the keys that meet in several components, and decides all possible pairs
whose members are still apart. Which keys these are is counted first; a bitmap of them goes to the tasks, so that few other rows are shuffled. So a large group of near copies does not square, and nothing hangs on the first pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procspark.llm import simhash_golay
from procspark.llm.common import arrow_map, only, raw
from procspark.operators.components import connected_components
from procspark.session import cut, lookup

WORDS = 5
SHARE = (4, 5)
CELLS = 1 << 20
BITS = 1024
FIRST = 4
NEAR_BITS = 11
_BLOCKS = 64
_MARKS = 1 << 26
_SEEN = 1 << 20
_ROWS = 30_000


def shingles(text: bytes, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Lower-case A-Z; the distinct hashes, sorted. Fewer words than ``words`` are one shingle; no words: none."""
    parts = text.lower().split()
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)] if parts else [], np.uint64)
    joined = b" ".join(parts)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b - 1], seed) for a, b in zip(starts, starts[words:])], np.uint64))


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Parities on as many bits as there are shingles or more, a power of two."""
    wide = max(BITS, 1 << (len(s) - 1).bit_length() if len(s) else 1)
    return (np.bincount((s % np.uint64(wide)).astype(np.int64), minlength=wide) & 1).astype(np.uint8)


def _folded(bits: np.ndarray, to: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, to), axis=0)


def _prefix(n: int, share: tuple[int, int]) -> int:
    num, den = share
    return n - -(-num * n // den) + 1 if n else 0


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def sets_of(docs: DataFrame, id_col: str, text_col: str, words: int, share: tuple[int, int] = SHARE, cells: int = CELLS) -> DataFrame:
    """``id, text_hash, node, size, bits, low, fp``: every row's set by its hash, its size, bitmap, first keys and SimHash fingerprint; and, where ``part`` is not
    null, ``part, counts``: a task's counts of shingles by their last bits, in blocks."""
    source = only(docs, id_col, text_col).withColumn("th*", _text_hash(text_col))
    kind = source.schema[id_col].dataType.simpleString()
    schema = pa.schema([("id", source.limit(0).toArrow().schema.field(0).type), ("text_hash", pa.int64()), ("node", pa.int64()), ("size", pa.int32()),
                        ("bits", pa.binary()), ("low", pa.list_(pa.int64())), ("fp", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
    mask = np.uint64(cells - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            found = [shingles(t, words) for t in raw(batch, text_col)]
            n = batch.num_rows
            if n:
                total += np.bincount((np.concatenate(found) & mask).astype(np.int64), minlength=cells)
            low = [s[:min(FIRST, _prefix(len(s), share))].view(np.int64) for s in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(schema.field(0).type), batch.column(2), pa.array(np.array([_node(s) for s in found], np.uint64).view(np.int64)),
                pa.array([len(s) for s in found], pa.int32()), pa.array([np.packbits(_folded(_bitmap(s), BITS)).tobytes() for s in found], pa.binary()),
                pa.array(low, pa.list_(pa.int64())), pa.array(np.array([simhash_golay.fingerprint_of(s) for s in found], np.uint64).view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        blocks = [(k, zstandard.compress(b.tobytes(), 1)) for k, b in enumerate(np.split(total, _BLOCKS)) if b.any()]
        if blocks:
            empty = [pa.nulls(len(blocks), f.type) for f in list(schema)[:7]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([k for k, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], schema=schema)

    return source.mapInArrow(run, f"id {kind}, text_hash bigint, node bigint, size int, bits binary, low array<bigint>, fp bigint, part int, counts binary")


def _counts(rows: DataFrame, cells: int) -> np.ndarray:
    """The tasks' counts added up, ``cells`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = np.frombuffer(zstandard.decompress(packed), np.int64)
                total[part] = total[part] + block if part in total else block
        if total:
            small = [np.minimum(b, 2**32 - 1).astype(np.uint32).tobytes() for b in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(small, pa.binary())], names=["part", "counts"])

    out = np.zeros((_BLOCKS, cells // _BLOCKS), np.uint32)
    for r in rows.filter("part is not null").select("part", "counts").repartition("part").mapInArrow(run, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def _marked(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size with a bit for every ``key``, by the key's last bits: tells most other keys apart."""
    mask = np.uint64(bits - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & mask
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7), dtype=np.uint8, casting="unsafe"))
        blocks = [(k, zstandard.compress(b.tobytes(), 1)) for k, b in enumerate(np.split(held, _BLOCKS)) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["part", "marks"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = np.frombuffer(zstandard.decompress(packed), np.uint8)
                total[part] = total[part] | block if part in total else block
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zstandard.compress(b.tobytes(), 1) for b in total.values()], pa.binary())],
                                         names=["part", "marks"])

    out = np.zeros((_BLOCKS, bits // 8 // _BLOCKS), np.uint8)
    kind = "part int, marks binary"
    for r in keys.select("key").mapInArrow(mark, kind).repartition("part").mapInArrow(merge, kind).collect():
        out[r["part"]] = np.frombuffer(zstandard.decompress(r["marks"]), np.uint8)
    return out.ravel()


def _keys(docs: DataFrame, text_col: str, words: int, counts: np.ndarray, share: tuple[int, int], marks: np.ndarray | None = None) -> DataFrame:
    """``key, node, size, pos``: the prefix of every set, rarest first, without what stands in one text; equal sets once per task or more.
    With ``marks``, keys without a bit there are left out."""
    sent = docs.sparkSession.sparkContext.broadcast((counts, marks))
    mask = np.uint64(len(counts) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, marked), seen = sent.value, set()
        for batch in batches:
            key, pos, node, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], []
            for t in raw(batch, text_col):
                s = shingles(t, words)
                name = _node(s)
                if name in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(name)
                often = table[(s & mask).astype(np.int64)]
                at = np.argsort(often, kind="stable")[:_prefix(len(s), share)]
                fits = often[at] > 1
                if marked is not None:
                    bit = s[at] & np.uint64(8 * len(marked) - 1)
                    fits &= (marked[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                place = np.flatnonzero(fits)
                key.append(s[at[place]])
                pos.append(place)
                node.append(name)
                size.append(len(s))
            times = [len(k) for k in key[1:]]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(key).view(np.int64)), pa.array(np.repeat(np.array(node, np.uint64), times).view(np.int64)),
                pa.array(np.repeat(np.array(size, np.int32), times)), pa.array(np.concatenate(pos).astype(np.int32))], names=["key", "node", "size", "pos"])

    return only(docs, text_col).mapInArrow(run, "key bigint, node bigint, size int, pos int")


def _met(keys: DataFrame, sets: DataFrame, tile: int, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``key, node, comp, size, pos, bits`` of the keys that meet in several components; ``again`` gives their rows, and few others, in place of ``keys``."""
    found = keys.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n"))
    shared = cut(found.filter("a <> b").select("key", "n"))
    keys = again(shared) if again else keys
    rows = _tiled(keys.join(lookup(shared.select("key")), "key", "left_semi").distinct(), shared, tile)
    return rows.join(sets.select("node", "bits").dropDuplicates(["node"]), "node")


def _possible(size: np.ndarray, pos: np.ndarray, bits: np.ndarray, a, b, share: tuple[int, int]) -> np.ndarray:
    """Whether sizes, bitmaps and places allow the similarity, if the key is the first shingle that both have."""
    num, den = share
    x, y = size[a], size[b]
    differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=-1, dtype=np.int64)
    left = np.minimum(x - pos[a], y - pos[b])
    return (num * np.maximum(x, y) <= den * np.minimum(x, y)) & (differ * (num + den) <= (x + y) * (den - num)) & (left * (num + den) >= num * (x + y))


def _pairs_of_groups(key, node, comp, size, pos, bits, share, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Possible pairs of different components inside each run of equal keys: a forest of them, or ``every`` one."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in np.unique(sizes).tolist():
        at = starts[sizes == n]
        if n == 1:
            continue
        if n <= (6 if every else 2):  # all groups of one size together
            i, j = np.triu_indices(n, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            apart = comp[a] != comp[b]
            a, b = a[apart], b[apart]
            fits = _possible(size, pos, bits, a, b, share)
            src.append(a[fits])
            dst.append(b[fits])
            continue
        for lo in at.tolist():
            left = np.arange(lo, lo + n)
            if (comp[left] == comp[lo]).all():
                continue
            queue: list[int] = []
            while len(left):
                if queue:
                    u = queue.pop()
                else:
                    u, left = int(left[0]), left[1:]
                other = left[comp[left] != comp[u]]
                close = other[_possible(size, pos, bits, u, other, share)]
                src.append(np.full(len(close), u))
                dst.append(close)
                if not every and len(close):
                    left = left[~np.isin(left, close)]
                    queue += close.tolist()
    a, b = node[np.concatenate(src)], node[np.concatenate(dst)]
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


def _pairs(rows: DataFrame, share: tuple[int, int], every: bool) -> DataFrame:
    """``src, dst`` of ``key, node, comp, size, pos, bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(held):
            a, b = _pairs_of_groups(*(np.concatenate(c) for c in zip(*held)), share, every)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(3)] + [batch.column(k).to_numpy().astype(np.int64) for k in (3, 4)]
            cols.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, BITS // 64))
            if n >= _ROWS and cols[0][-1] != held[0][0][0]:
                at = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
                held.append([c[:at] for c in cols])
                yield judged(held)
                held, n, cols = [], 0, [c[at:] for c in cols]
            held.append(cols)
            n += len(cols[0])
        if held:
            yield judged(held)

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by node as well: the forests of a group's keys are then mostly the same pairs
    dealt = rows.select("key", "node", "comp", "size", "pos", "bits").repartition(width, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "src bigint, dst bigint").distinct()


def _fits(x: bytes, y: bytes, total: int, share: tuple[int, int]) -> bool:
    """Whether the wide bitmaps allow the similarity; the wider is folded."""
    num, den = share
    a, b = (np.unpackbits(np.frombuffer(p, np.uint8)) for p in (x, y))
    to = min(len(a), len(b))
    return int((_folded(a, to) ^ _folded(b, to)).sum()) * (num + den) <= total * (den - num)


def _texts(docs: DataFrame, text_col: str, words: int, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, size, wide, s``: the sets of the pairs' members and their wide bitmaps, made from one text each."""
    nodes = lookup(pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct())
    wanted = lookup(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("th*")).select("th*").distinct())
    texts = only(docs, text_col).withColumn("th*", _text_hash(text_col)).join(wanted, "th*", "left_semi").select(f"`{text_col}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = {}
            for t in raw(batch, text_col):
                s = shingles(t, words)
                name = _node(s)
                if name not in seen:
                    found[name] = s
                    seen.add(name)
            if len(seen) >= _SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array([len(s) for s in found.values()], pa.int32()),
                pa.array([np.packbits(_bitmap(s)).tobytes() for s in found.values()], pa.binary()),
                pa.array([s.tobytes() for s in found.values()], pa.binary())], names=["node", "size", "wide", "s"])

    return cut(texts.mapInArrow(run, "node bigint, size int, wide binary, s binary").dropDuplicates(["node"]))


def _with_both(pairs: DataFrame, texts: DataFrame, what: str) -> DataFrame:
    """``src, dst, x, y, m, n``: the column of both, and their sizes."""
    few = texts.select("node", "size", F.col(what).alias("x"))
    one = pairs.join(few.select(F.col("node").alias("src"), "x", F.col("size").alias("m")), "src")
    return one.join(few.select(F.col("node").alias("dst"), F.col("x").alias("y"), F.col("size").alias("n")), "dst").select("src", "dst", "x", "y", "m", "n")


def _similar(pairs: DataFrame, texts: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs whose sets have the similarity: first by the wide bitmaps, then by the sets."""
    num, den = share

    def allowed(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(k).to_pylist() for k in range(2, 6)]
        return batch.select([0, 1]).filter(pa.array([_fits(x, y, m + n, share) for x, y, m, n in zip(*cols)], pa.bool_()))

    def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = ([np.frombuffer(p, np.uint64) for p in batch.column(k).to_pylist()] for k in (2, 3))
        same = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(x, y)], np.int64)
        both = np.array([len(a) + len(b) for a, b in zip(x, y)], np.int64)
        return batch.select([0, 1]).filter(pa.array(same * den >= num * (both - same)))

    left = cut(arrow_map(_with_both(pairs, texts, "wide"), allowed, "src bigint, dst bigint"))
    return arrow_map(_with_both(left, texts, "s"), similar, "src bigint, dst bigint")


def _tiled(rows: DataFrame, shared: DataFrame, tile: int) -> DataFrame:
    """Rows of keys that many sets share go into tiles; every pair of tiles, and each tile with itself, is one group."""
    hot = shared.filter(F.col("n") > tile)
    if hot.isEmpty():
        return rows
    tiles = hot.select("key", F.ceil(2 * F.col("n") / tile).cast("int").alias("tiles"))
    dealt = rows.join(lookup(tiles), "key", "left").withColumn("a", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    split = dealt.filter("tiles is not null").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    split = split.withColumn("key", F.xxhash64("key", F.least("a", "b"), F.greatest("a", "b")))
    return dealt.filter("tiles is null").select(*rows.columns).unionByName(split.select(*rows.columns))


def print_pairs(sets: DataFrame, tile: int = simhash_golay.TILE) -> DataFrame:
    """``src, dst``: sets (``node, fp``) with one fingerprint, each with the least of them; and of linked fingerprints the least sets."""
    lead = cut(sets.groupBy("fp").agg(F.min("node").alias("lead")))
    same = sets.select("fp", "node").join(lead, "fp").filter("node <> lead").select(F.col("lead").alias("src"), F.col("node").alias("dst"))
    close = simhash_golay.links(lead.select("fp"), tile, NEAR_BITS).join(lead.select(F.col("fp").alias("src"), F.col("lead").alias("a")), "src").join(
        lead.select(F.col("fp").alias("dst"), F.col("lead").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return same.unionByName(close).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE,
                cells: int = CELLS, marks: int = _MARKS, tile: int = simhash_golay.TILE) -> DataFrame:
    """``id, component_id``: one row per row of ``docs``; the smallest id reachable over pairs of texts with a shingle similarity of
    ``share`` (numerator, denominator) or more. ``cells`` (a power of two, 64 or more) is the size of the table of counts, ``marks`` (a
    power of two, 512 or more) of the bitmap of shared keys; they change the cost alone.

    Texts without words are equal to each other. Null ids pass links on and name no component. Repeated rows come out as often as they come in.
    """
    made = cut(sets_of(docs, id_col, text_col, words, share, cells))
    sets = made.filter("part is null").drop("part", "counts")

    def decided(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        return cut(_similar(pairs, _texts(docs, text_col, words, pairs, sets), share))

    def links_of(keys: DataFrame, every: bool, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        return decided(_pairs(_met(keys, sets, tile, again), share, every))

    links = decided(print_pairs(sets, tile))
    member = lookup(connected_components(links).withColumnRenamed("component", "c"))
    first = sets.select(F.posexplode("low").alias("pos", "key"), "node", "size").join(member, "node", "left")
    first = first.select("key", "node", "size", "pos", F.coalesce("c", "node").alias("comp"))
    links = links.unionByName(links_of(first.distinct(), every=False))
    member = lookup(connected_components(links).withColumnRenamed("component", "c"))
    counts = _counts(made, cells)

    def placed(shared: DataFrame | None = None) -> DataFrame:
        keys = _keys(docs, text_col, words, counts, share, None if shared is None else _marked(shared, marks))
        return keys.join(member.select("node", "c"), "node", "left").select("key", "node", "size", "pos", F.coalesce("c", "node").alias("comp"))

    more = links_of(placed(), True, placed)
    member = connected_components(cut(links.unionByName(more)))
    distinct = sets.groupBy("node").agg(F.min("id").alias("first"))
    placed = cut(distinct.join(member, "node", "left").withColumn("component", F.coalesce("component", "node")))
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = placed.select("node", "component").join(names, "component").select("node", "component_id")
    return sets.select("id", "node").join(by_node, "node").select(F.col("id").alias(id_col), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of near copies, with all columns, by the rules of ``simhash_golay.keep_first``."""
    return simhash_golay.keep_named(docs, near_copies(docs, id_col, text_col), id_col)
