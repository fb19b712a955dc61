"""Candidate pairs of a string similarity join from rare q-grams, complete and without comparing all names of a gram.

A ratio of at least ``t`` leaves at most ``D = (1 - t)(|a| + |b|)`` characters unmatched: ``x`` deleted from ``a`` and ``y`` inserted, with
``x - y = |a| - |b|``. A deletion touches ``q`` grams of ``a`` and an insertion ``q - 1``, so at least ``c`` grams stay, in order and moved by no more
than the edits. With the grams of all names in one global order, rarest first, two names that share ``c`` grams share ``k`` of them
among their first ``G - c + k``. ``k`` is 3 wherever ``c`` allows, and as many of the three make a key as it takes to be rare:

* the first alone, if it is a rare gram of the whole table; the rows under such a key are bounded;
* else the first two, if gram counts let few names hold both: names only meet if they share a second gram;
* else all three.

What decides are counts of the whole table, so both names of a pair take the same form. Bigrams are used, as a common word then only
comes into the keys of names that are half common words. Lengths, places and a print of all grams are compared inside the join, before a pair
exists; keys with many rows are joined in tiles. Key rows hold numbers only: texts are joined to the pairs that are left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procspark.operators.pairs import pair_tiles
from procspark.session import cut, shuffle_width

EPS = 1e-9
RARE = 64
_NAMES = 1_000  # names whose keys are made at once
_BUCKETS = 1 << 16  # gram counts are kept by checksum: a table of fixed size, whatever the alphabet
_SCHEMES = ((2, 3), (2, 2), (2, 1), (1, 1))  # q, k: the first that a pair's lengths allow


def edits(n: int, m: int, threshold: float) -> int:
    return int((1 - threshold) * (n + m) + EPS)


def _lost(n: int, m: int, q: int, threshold: float) -> int | None:
    """How many q-grams of a name of ``n`` characters a partner of ``m`` may not share; None if it can't be a partner."""
    d = edits(n, m, threshold)
    if abs(n - m) > d:
        return None
    d -= (d - abs(n - m)) % 2
    x, y = (d + n - m) // 2, (d - n + m) // 2
    return q * x + (q - 1) * y


def _partners(n: int, threshold: float) -> list[int]:
    return [m for m in range(1, int(n * (2 - threshold) / max(threshold, 0.01) + 1) + 1) if abs(n - m) <= edits(n, m, threshold)]


@cache
def scheme(longer: int, threshold: float) -> int:
    """Which scheme pairs take whose longer name has this length."""
    partners = [m for m in _partners(longer, threshold) if m <= longer]
    for number, (q, k) in enumerate(_SCHEMES):
        if all(longer - q + 1 - _lost(longer, m, q, threshold) >= k for m in partners):
            return number
    raise ValueError("the threshold leaves nothing in common")


@cache
def prefixes(n: int, threshold: float) -> tuple[tuple[int, int], ...]:
    """``(scheme, grams to take)`` of a name of this length, over all lengths a partner may have."""
    out: dict[int, int] = {}
    for m in _partners(n, threshold):
        number = scheme(max(n, m), threshold)
        q, k = _SCHEMES[number]
        out[number] = max(out.get(number, 0), _lost(n, m, q, threshold) + k)
    return tuple(sorted(out.items()))


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % _BUCKETS


def gram_counts(names: DataFrame, name: str) -> dict[int, np.ndarray]:
    """Occurrences of the grams of every size in all names, by bucket: one pass, at most ``2 * _BUCKETS`` rows reach the driver."""

    def grams(q: int) -> Column:
        n = F.length(name) - (q - 1)
        places = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.lit(q).alias("q"), (F.crc32(F.substring(F.col(name), i, F.lit(q)).cast("binary")) % _BUCKETS).alias("b")))

    sizes = sorted({q for q, _ in _SCHEMES})
    rows = names.select(F.explode(F.concat(*map(grams, sizes))).alias("g")).groupBy("g.q", "g.b").agg(F.count("*").alias("n")).collect()
    out = {q: np.zeros(_BUCKETS, np.int64) for q in sizes}
    for r in rows:
        out[r.q][r.b] = r.n
    return out


@cache
def _combinations(n: int, k: int) -> tuple[np.ndarray, ...]:
    return tuple(np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(-1, k).T)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def keys_of(name: str, counts: dict[int, np.ndarray], total: int, threshold: float, rare: int = RARE) -> np.ndarray:
    """``key, place, place, place`` of every key of a name; a key of fewer grams repeats its last place. ``total`` is the number of names."""
    out = [np.empty((0, 4), np.uint64)]
    for number, take in prefixes(len(name), threshold):
        q, k = _SCHEMES[number]
        ranked = sorted((int(counts[q][_bucket(g)]), g, i) for i, g in enumerate(name[i:i + q] for i in range(len(name) - q + 1)))[:take]
        n = len(ranked)
        if n < k:
            continue
        few = np.array([c for c, *_ in ranked], np.int64)
        place = np.array([i for *_, i in ranked], np.uint64)
        sums = np.array([zlib.crc32(f"{number}{g}".encode()) for _, g, _ in ranked], np.uint64)
        alone = few <= rare if k > 1 else np.ones(n, bool)
        a = np.flatnonzero(alone[:n - k + 1])
        out.append(np.stack([_mixed(sums[a], sums[a]), place[a], place[a], place[a]], axis=1))
        if k == 1:
            continue
        two = few[:, None] * few <= rare * total if k == 3 else np.ones((n, n), bool)
        a, b = _combinations(n - k + 2, 2)
        here = ~alone[a] & two[a, b]
        a, b = a[here], b[here]
        out.append(np.stack([_mixed(sums[a], sums[b]), place[a], place[b], place[b]], axis=1))
        if k == 3:
            a, b, c = _combinations(n, 3)
            here = ~alone[a] & ~two[a, b]
            a, b, c = a[here], b[here], c[here]
            out.append(np.stack([_mixed(_mixed(sums[a], sums[b]), sums[c]), place[a], place[b], place[c]], axis=1))
    return np.concatenate(out)


def print_of(name: str) -> int:
    """64 parities of the bigrams of a name; an edit changes at most three of them."""
    x = 0
    for i in range(len(name) - 1):
        x ^= 1 << (zlib.crc32(name[i:i + 2].encode()) & 63)
    return x


def near(n: Column, m: Column, x: Column, y: Column, left: list[Column], right: list[Column], threshold: float) -> Column:
    """Whether the lengths, the prints and the places of what two names share allow the ratio. Kept short: it runs in the join, once for each row pair of a key."""
    d = F.floor((1 - threshold) * (n + m) + EPS)
    ok = (F.abs(n - m) <= d) & (F.bit_count(x.bitwiseXOR(y)) <= 3 * d)
    for p, r in zip(left, right):
        ok = ok & (F.abs(2 * (p - r) - (n - m)) <= d)
    return ok


def numbered(names: DataFrame, name: str) -> DataFrame:
    """``names`` with a number ``id`` for each row, dealt over the session's tasks and frozen in the shared folder: however few bytes names have,
    their keys are many."""
    return cut(names.repartition(shuffle_width(names.sparkSession), name).withColumn("id", F.monotonically_increasing_id()))


def keyed(names: DataFrame, name: str, threshold: float, rare: int = RARE) -> DataFrame:
    """``member, key, n, x, p, q, s``: the keys of every name with its length, its print and the places of the grams; frozen in the shared folder.
    ``member`` is the ``id`` that ``numbered`` gave."""
    held = (names if "id" in names.columns else numbered(names, name)).select("id", name)
    counts, total = gram_counts(held, name), held.count()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [keys_of(t, counts, total, threshold, rare) for t in texts]
        each = np.array([len(f) for f in found], dtype=np.int64)
        flat = np.concatenate([np.empty((0, 4), np.uint64), *found])
        n = np.repeat(np.array([len(t) for t in texts], dtype=np.int32), each)
        x = np.repeat(np.array([print_of(t) for t in texts], dtype=np.uint64), each)
        member = np.repeat(batch.column(0).to_numpy(), each)
        return pa.RecordBatch.from_arrays(
            [pa.array(member), pa.array(flat[:, 0].copy().view(np.int64)), pa.array(n), pa.array(x.view(np.int64)), *(pa.array(flat[:, c].astype(np.int32)) for c in (1, 2, 3))],
            names=["member", "key", "n", "x", "p", "q", "s"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _NAMES):
                yield run(batch.slice(lo, _NAMES))

    return cut(held.mapInArrow(parts, "member bigint, key bigint, n int, x bigint, p int, q int, s int"))


def meetings(keys: DataFrame, threshold: float, block_rows: int = 2_000) -> DataFrame:
    """``l, r``: numbers of names under one key whose lengths, prints and places allow the ratio; a pair once for each key it shares."""
    met = pair_tiles(keys, ["key"], "member", ["n", "x", "p", "q", "s"], block_rows)
    close = near(F.col("l_n"), F.col("r_n"), F.col("l_x"), F.col("r_x"), [F.col(f"l_{c}") for c in "pqs"], [F.col(f"r_{c}") for c in "pqs"], threshold)
    return met.filter(close).select(F.col("l_member").alias("l"), F.col("r_member").alias("r"))


def candidates(names: DataFrame, name: str, threshold: float, rare: int = RARE, block_rows: int = 2_000) -> DataFrame:
    """``l, r``: every pair of different rows of ``names`` that may reach the ratio, once, and the other columns of both rows as ``l_*`` and ``r_*``.
    ``names`` are distinct and not empty. The edit bound is checked with the built-in distance.
    """
    held = numbered(names, name)
    pairs = meetings(keyed(held, name, threshold, rare), threshold, block_rows).distinct()
    others = [c for c in names.columns if c != name]
    side = lambda p: held.select(F.col("id").alias(f"{p}_id"), F.col(name).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in others])
    # sizes foretold for pairs follow those of the names, far below the rows there may be: no side is sent whole
    both = pairs.select(F.col("l").alias("l_id"), F.col("r").alias("r_id")).hint("merge").join(side("l"), "l_id").hint("merge").join(side("r"), "r_id")
    limit = f"CAST(floor({1 - threshold} * (length(l) + length(r)) + {EPS}) AS INT)"
    return both.filter(f"levenshtein(l, r, {limit}) >= 0").drop("l_id", "r_id")
