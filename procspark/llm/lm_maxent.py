"""Hashed maximum-entropy language model with a class-factored softmax.

``P(word | history) = P(class | history) * P(word | class, history)``. The first factor is a softmax over the classes whose features are
the last word, the word before it (a skip) and both together, hashed into the rows of one table. The second has the same features:
the words of a class are the leaves of a binary tree whose halves weigh alike, and every fork is a softmax over its two sides, with the log odds
of the counts as its constant and one weight for each feature and fork, hashed into a second table. So the factor is normalised exactly
along one path. Words too rare for the tree share one leaf of their class; which of them it is follows from relative counts, smoothed by one,
with one part for unseen words. End of text is a word of its own class, the most frequent words have classes of their own, and every
other word's class follows from its last letters: where those letters occur most, told by the most frequent word of the texts. So a class
can be found for any word, seen or not.

Both tables are trained on all training texts by gradient steps in every task on its share of the texts; the tasks' weights are averaged,
weighted by how often a task met the feature (at forks: by its squared slopes), and the next round starts from the average. What a task sends has the size of
the tables, which are parameters; word counts are gathered from the whole corpus.

Counts of the most frequent words, at most ``2^20`` by their share of all words, travel to the scoring tasks. All other words of
a text are joined with the count table, so no vocabulary is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procspark.session import cut

_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_HELD_WORDS = 2_000_000  # counts that a task gathers before it sends them on
SUFFIXES, GROUPS = 4096, 16
_ENTRY_BITS = 20


@dataclass(frozen=True)
class Shape:
    """Sizes of the model. ``heads``: words with a class of their own."""

    rows: int = 1 << 14
    inner: int = 1 << 18  # weights of the forks inside classes, a power of two
    heads: int = 11
    rounds: int = 2
    rate: float = 0.15
    inner_rate: float = 0.15
    step: int = 8192  # tokens of one gradient step
    inner_step: int = 1 << 15  # of one at the forks, which goes over their whole table
    frequent: int = 1 << 20  # share of all words, as 1 / frequent, from which on a word's count is sent along
    share: int = 1 << 21  # training words for which one table is sent, at least
    folds: int = 7
    fold: int = 2

    @property
    def classes(self) -> int:
        return 1 + self.heads + GROUPS


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b".,;:!?")] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64  # longer words are hashed one by one


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of a batch of texts, end to end: 64-bit hashes of their lower-case bytes, suffix buckets, words per text."""

    hash: np.ndarray
    suffix: np.ndarray
    sizes: np.ndarray


def words_of(batch: pa.RecordBatch, name: str = "text") -> Words:
    """All words of a string column at once, from its bytes; a null text has none."""
    data, offsets = column_bytes(batch, name)
    n, texts = len(data), len(offsets) - 1
    low, inside = _LOWER[data], ~_IS_SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True  # the first byte of a text begins a word whatever stands before it
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last[:-1] &= ~inside[1:] | border[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = np.bincount(np.searchsorted(offsets, start, side="right") - 1, minlength=texts)[:texts] if n else np.zeros(texts, np.int64)
    length = end - start
    order = np.argsort(-np.minimum(length, _LONG), kind="stable")
    s, sorted_length = start[order], length[order]
    h = np.zeros(len(s), np.uint64)
    for j in range(_LONG):  # the words longer than j come first
        k = np.searchsorted(-sorted_length, -j)
        if not k:
            break
        h[:k] = h[:k] * _STEP + (low[s[:k] + j].astype(np.uint64) + np.uint64(1))
    out = np.empty(len(s), np.uint64)
    out[order] = _mix(h)
    for w in np.flatnonzero(length > _LONG).tolist():
        out[w] = xxhash.xxh64_intdigest(low[start[w]:end[w]].tobytes(), 3)
    stop = end.copy()
    for _ in range(4):  # closing marks are no part of a suffix
        mark = np.flatnonzero((stop > start) & _IS_MARK[low[np.maximum(stop - 1, 0)]]) if n else []
        if not len(mark):
            break
        stop[mark] -= 1
    code = np.zeros(len(s), np.uint64)
    for back in (1, 2, 3):
        at = stop - back
        code = code << np.uint64(8) | np.where(at >= start, low[np.maximum(at, 0)], 0).astype(np.uint64) if n else code
    bucket = (code * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - (SUFFIXES.bit_length() - 1))
    return Words(out, bucket.astype(np.int64), sizes)


def column_bytes(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and where each row starts; nulls are empty."""
    col = batch.column(name).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    whole = col.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0]:offsets[-1]] if whole is not None and len(col) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _group(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(GROUPS)).astype(np.int64)


def _tally(hashes: np.ndarray, suffix: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal hashes added up."""
    h, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    return h, suffix[at], np.bincount(back, counts, len(h)).astype(np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """``w, s, g, c``: counts of a task's words by hash and suffix bucket (``g`` null), and of the buckets by group of texts (``w`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SUFFIXES, GROUPS), np.int64)
        held, ends = [], 0

        def rows(w, s, g, c):
            return pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(s, pa.int32()), pa.array(g, pa.int32()), pa.array(c, pa.int64())],
                                              names=["w", "s", "g", "c"])

        def told():
            h, s, c = _tally(*[np.concatenate(x) for x in zip(*held)])
            for lo in range(0, len(h), 100_000):
                part = slice(lo, lo + 100_000)
                yield rows(h[part].view(np.int64), s[part], [None] * len(h[part]), c[part])
            held.clear()

        for batch in batches:
            words = words_of(batch)
            ends += len(words.sizes)
            if not len(words.hash):
                continue
            doc = np.repeat(np.arange(len(words.sizes)), words.sizes)
            order = np.lexsort((words.hash, doc))
            h, d = words.hash[order], doc[order]
            heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
            n = np.diff(np.append(heads, len(h)))
            h, d, suffix = h[heads], d[heads], words.suffix[order[heads]]
            best = np.lexsort((h, -n, d))  # a text's group follows from its most frequent word
            best = best[np.concatenate([[True], d[best][1:] != d[best][:-1]])]
            group = np.zeros(len(words.sizes), np.int64)
            group[d[best]] = _group(h[best])
            table += np.bincount(suffix * GROUPS + group[d], n, SUFFIXES * GROUPS).astype(np.int64).reshape(SUFFIXES, GROUPS)
            held.append(_tally(h, suffix, n))
            if sum(len(x[0]) for x in held) > _HELD_WORDS:
                yield from told()
        if held:
            yield from told()
        if ends:
            s, g = np.nonzero(table)
            yield rows([None] * len(s), s, g, table[s, g])
            yield rows([int(_END.astype(np.int64))], [-1], [None], [ends])

    return texts.mapInArrow(run, "w bigint, s int, g int, c bigint")


@dataclass
class Trees:
    """The frequent words of each class as leaves in a row, split where both sides weigh alike; a fork is named by the place of its split."""

    leaf: np.ndarray  # of each frequent word; -1 for words that are a class
    rest: np.ndarray  # of each class: the leaf of all its other words; -1 for classes of one word
    rest_total: np.ndarray  # of each class: training words at that leaf, smoothed
    root: np.ndarray  # of each class: its first fork; -1 for a single leaf
    left: np.ndarray  # of each fork: the next one, or -1
    right: np.ndarray
    odds: np.ndarray  # of each fork: log of the counts on the right over those on the left

    def paths(self, leaf: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All forks on the way to the leaves (-1: none): number of the leaf in the input, fork, whether the way goes right."""
        at = np.flatnonzero(leaf >= 0)
        fork = self.root[cls[at]]
        found = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool))]
        while True:
            on = fork >= 0
            at, fork = at[on], fork[on]
            if not len(at):
                return tuple(np.concatenate(x) for x in zip(*found))
            turn = leaf[at] >= fork
            found.append((at, fork, turn))
            fork = np.where(turn, self.right[fork], self.left[fork])


def _grow(cls: np.ndarray, counts: np.ndarray, rest_total: np.ndarray) -> Trees:
    """Trees over words by class and count (class -1: no leaf), with one more leaf a class for the rest, where that is not zero."""
    word, with_rest = np.flatnonzero(cls >= 0), np.flatnonzero(rest_total > 0)
    kind = np.concatenate([cls[word], with_rest])
    weight = np.concatenate([counts[word] + 1.0, rest_total[with_rest]])
    order = np.lexsort((np.arange(len(kind)), -weight, kind))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    leaf, rest = np.full(len(cls), -1, np.int32), np.full(len(rest_total), -1, np.int32)
    leaf[word], rest[with_rest] = place[:len(word)], place[len(word):]
    below = np.concatenate([[0.0], np.cumsum(weight[order])])
    root = np.full(len(rest_total), -1, np.int32)
    left, right, odds = np.full(len(below), -1, np.int32), np.full(len(below), -1, np.int32), np.zeros(len(below), np.float32)
    sorted_kind = kind[order]
    classes = np.arange(len(rest_total))
    lo, hi = np.searchsorted(sorted_kind, classes, side="left"), np.searchsorted(sorted_kind, classes, side="right")
    parent, side = classes, root  # the place that is told of the next fork
    into = [(parent, side, lo, hi)]
    while into:
        level = []
        for parent, side, lo, hi in into:
            many = hi - lo >= 2
            parent, lo, hi = parent[many], lo[many], hi[many]
            if not len(lo):
                continue
            half = np.clip(np.searchsorted(below, (below[lo] + below[hi]) / 2), lo + 1, hi - 1)
            side[parent] = half
            odds[half] = np.log((below[hi] - below[half]) / (below[half] - below[lo]))
            level += [(half, left, lo, half), (half, right, half, hi)]
        into = _joined(level, left, right)
    return Trees(leaf, rest, rest_total, root, left, right, odds)


def _joined(level: list, left: np.ndarray, right: np.ndarray) -> list:
    """One entry a side."""
    out = []
    for side in (left, right):
        parts = [(p, lo, hi) for p, s, lo, hi in level if s is side]
        if parts:
            p, lo, hi = [np.concatenate(x) for x in zip(*parts)]
            out.append((p, side, lo, hi))
    return out


@dataclass
class Vocabulary:
    """What the driver knows of the counts: sizes bounded by the shape, whatever the corpus."""

    total: int
    distinct: int
    heads: np.ndarray  # hashes of the words with their own classes
    suffix_class: np.ndarray  # class of each suffix bucket
    hashes: np.ndarray  # sorted, of frequent words
    counts: np.ndarray
    class_total: np.ndarray  # training words of each class
    class_distinct: np.ndarray
    ends: int
    trees: Trees
    entry: np.ndarray | None = None

    def classes(self, hashes: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        out = self.suffix_class[suffix]
        for k, h in enumerate(self.heads):
            out[hashes == h] = 1 + k
        return out

    def leaves(self, found: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Leaf of words in the tree of their class, from ``find``."""
        return np.where(found >= 0, self.trees.leaf[found], self.trees.rest[cls]) if len(self.hashes) else self.trees.rest[cls]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of frequent words; -1 for all others. The sorted hashes are entered by their upper bits."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        if self.entry is None:
            upper = (self.hashes >> np.uint64(64 - _ENTRY_BITS)).astype(np.int64)
            self.entry = np.searchsorted(upper, np.arange((1 << _ENTRY_BITS) + 1))
        slot = (hashes >> np.uint64(64 - _ENTRY_BITS)).astype(np.int64)
        at, stop = self.entry[slot], self.entry[slot + 1]
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            same = self.hashes[at[open_]] == hashes[open_]
            hit = open_[same]
            out[hit] = at[hit]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out


def _learn_counts(training: DataFrame, shape: Shape) -> tuple[DataFrame, Vocabulary]:
    """``w, c`` of all training words as a written table, and the driver's share of it."""
    rows = cut(count_words(training).groupBy("w", "s", "g").agg(F.sum("c").alias("c")))
    table = np.zeros((SUFFIXES, GROUPS), np.int64)
    for r in rows.filter("w is null").collect():  # at most SUFFIXES * GROUPS
        table[r["s"], r["g"]] = r["c"]
    suffix_class = 1 + shape.heads + table.argmax(axis=1)
    words = rows.filter("w is not null").select("w", "s", "c")
    class_total, class_distinct, ends = np.zeros(shape.classes), np.zeros(shape.classes), 0
    total = distinct = 0
    for r in words.groupBy("s").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # at most SUFFIXES + 1
        k = suffix_class[r["s"]] if r["s"] >= 0 else 0
        class_total[k] += r["c"]
        class_distinct[k] += r["n"]
        total, distinct, ends = total + r["c"], distinct + r["n"], ends if k else r["c"]
    frequent = words.filter(F.col("c") >= max(1, total / shape.frequent)).toArrow()  # at most shape.frequent rows
    h, s, c = frequent.column("w").to_numpy().view(np.uint64), frequent.column("s").to_numpy(), frequent.column("c").to_numpy()
    inner = np.flatnonzero(s >= 0)
    top = inner[np.lexsort((h[inner], -c[inner]))][:shape.heads]
    for k, j in enumerate(top):  # a head leaves the class of its suffix
        class_total[suffix_class[s[j]]] -= c[j]
        class_distinct[suffix_class[s[j]]] -= 1
        class_total[1 + k], class_distinct[1 + k] = c[j], 1
    order = np.argsort(h)
    h, s, c, heads = h[order], s[order], c[order], h[top]
    own = np.where((s < 0) | np.isin(h, heads), -1, suffix_class[s])
    inner = own >= 0
    rest = class_total + class_distinct + 1 - np.bincount(own[inner], c[inner] + 1, shape.classes)
    rest[:1 + shape.heads] = 0
    return words.select("w", "c"), Vocabulary(total, distinct, heads, suffix_class, h, c, class_total, class_distinct, ends, _grow(own, c, rest))


def _tokens(words: Words, cls: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts' words, each text's followed by an end: feature rows (3 per token), class, text number, word number or -1, and
    the features' hashes (3 rows of 32 bits)."""
    sizes, flat = words.sizes, np.arange(len(words.hash))
    ends = np.cumsum(sizes + 1) - 1
    n = int(len(flat) + len(sizes))
    is_word = np.ones(n, bool)
    is_word[ends] = False
    word = np.full(n, -1, np.int64)
    word[is_word] = flat
    value = np.full(n, _END, np.uint64)
    value[is_word] = words.hash
    target = np.zeros(n, np.int64)
    target[is_word] = cls
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    first = ends - sizes
    one = np.full(n, _START, np.uint64)
    one[1:] = value[:-1]
    one[first] = _START
    two = np.full(n, _START, np.uint64)
    two[2:] = value[:-2]
    two[first] = _START
    two[(first + 1)[sizes > 0]] = _START
    bits = np.uint64(64 - (shape.rows.bit_length() - 1))
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    features = np.stack([one * a, two * b, (one * b ^ (two >> np.uint64(7))) * c])
    rows = (features >> bits).T.astype(np.uint16 if shape.rows <= 1 << 16 else np.int64, order="C")
    return rows, target, doc, word, (features >> np.uint64(32)).astype(np.uint32)


def _log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = weights[rows[:, 0]] + weights[rows[:, 1]] + weights[rows[:, 2]]
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def _fork_features(features: np.ndarray, fork: np.ndarray, shape: Shape) -> np.ndarray:
    """Places of three features (rows) at their forks in the table of ``shape.inner`` weights."""
    places = features ^ (fork.astype(np.uint32) * np.uint32(0x9E3779B1))
    places *= np.uint32(0x85EBCA6B)
    places >>= np.uint32(32 - (shape.inner.bit_length() - 1))
    return places.astype(np.intp)


def _log_right(inner: np.ndarray, places: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Log odds of the right side at forks, given the counts' and the features' places."""
    x = odds + inner.take(places[0])
    x += inner.take(places[1])
    x += inner.take(places[2])
    return np.clip(x, -30, 30, out=x)


def _log_inner(trees: Trees, inner: np.ndarray, features: np.ndarray, leaf: np.ndarray, cls: np.ndarray, shape: Shape) -> np.ndarray:
    """Log probability of each token's leaf in the tree of its class; 0 without a leaf."""
    at, fork, turn = trees.paths(leaf, cls)
    x = _log_right(inner, _fork_features(np.take(features, at, axis=1), fork, shape), trees.odds[fork])
    x *= 1 - 2 * turn.astype(np.float32)
    np.exp(x, out=x)
    x += 1
    return -np.bincount(at, np.log(x, out=x), len(leaf))


_BLOCK = 1024
_INNER_BLOCK = 1 << 15


def _train_round(texts: DataFrame, vocabulary: Vocabulary, start: tuple[np.ndarray, np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The averaged tables, of classes and of forks, after every task's gradient steps over its texts, from ``start``."""
    sent = texts.sparkSession.sparkContext.broadcast((vocabulary, start))
    # small partitions share a task: tables are sent by the number of words, not of partitions
    texts = texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, vocabulary.total // shape.share))
    k = shape.classes
    outer_blocks, inner_block = -(-shape.rows // _BLOCK), min(_INNER_BLOCK, shape.inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (weights, inner) = sent.value
        weights, inner = weights.copy(), inner.copy()
        squares, inner_squares = np.full_like(weights, 1e-3), np.zeros_like(inner)
        seen = np.zeros(shape.rows, np.int64)
        for batch in batches:
            words = words_of(batch)
            cls = v.classes(words.hash, words.suffix)
            rows, target, _, word, features = _tokens(words, cls, shape)
            leaf = np.full(len(word), -1, np.int32)
            leaf[word >= 0] = v.leaves(v.find(words.hash), cls)
            seen += np.bincount(rows.ravel(), minlength=shape.rows)
            for lo in range(0, len(target), shape.step):
                r, y = rows[lo:lo + shape.step], target[lo:lo + shape.step]
                slope = np.exp(_log_softmax(weights, r))
                slope[np.arange(len(y)), y] -= 1
                every = r.T.ravel()
                order = np.argsort(every, kind="stable")
                held = every[order]
                heads = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
                total = np.add.reduceat(slope[order % len(y)], heads, axis=0)
                at = held[heads]
                squares[at] += total * total
                weights[at] -= shape.rate * total / np.sqrt(squares[at])
            for lo in range(0, len(target), shape.inner_step):
                part = slice(lo, lo + shape.inner_step)
                at, fork, turn = v.trees.paths(leaf[part], target[part])
                places = _fork_features(np.take(features[:, part], at, axis=1), fork, shape)
                slope = 1 / (1 + np.exp(-_log_right(inner, places, v.trees.odds[fork]))) - turn
                total = np.bincount(places.ravel(), np.tile(slope, 3), shape.inner).astype(np.float32)
                inner_squares += total * total
                inner -= shape.inner_rate * total / np.sqrt(1 + inner_squares)
        if seen.any():
            part = TaskContext.get().partitionId()
            sums = weights * seen[:, None].astype(np.float32)
            blobs = [(sums[b:b + _BLOCK], seen[b:b + _BLOCK]) for b in range(0, shape.rows, _BLOCK)]
            sums = inner * inner_squares
            blobs += [(sums[b:b + inner_block], inner_squares[b:b + inner_block]) for b in range(0, shape.inner, inner_block)]
            for b, (value, times) in enumerate(blobs):
                blob = np.concatenate([value.ravel(), times]).astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([b]), pa.array([blob], pa.binary())], names=["part", "block", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of blocks that come in order: one block is held at a time."""
        name, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([name[0]]), pa.array([name[1]]), pa.array([total.astype("<f4").tobytes()], pa.binary())],
                                              names=["part", "block", "sums"])

        for batch in batches:
            for part, block, sums in zip(*[batch.column(c).to_pylist() for c in ("part", "block", "sums")]):
                if (part, block) != name:
                    if name is not None:
                        yield out()
                    name, total = (part, block), np.zeros(len(sums) // 4, np.float64)
                total += np.frombuffer(sums, "<f4")
        if name is not None:
            yield out()

    kind = "part bigint, block bigint, sums binary"
    shared = texts.mapInArrow(run, kind)
    tasks = texts.rdd.getNumPartitions()
    while True:  # sums of 64 tasks at a time, so no task reads the tables of all
        shared = shared.withColumn("part", F.floor(F.col("part") / 64)).repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(added, kind)
        tasks = -(-tasks // 64)
        if tasks <= 1:
            break
    out, inner = start[0].copy(), start[1].copy()
    for r in shared.collect():  # the tables, once
        data = np.frombuffer(r["sums"], "<f4")
        if r["block"] >= outer_blocks:
            b, (value, steps) = (r["block"] - outer_blocks) * inner_block, data.reshape(2, -1)
            known = steps > 1e-12
            inner[b:b + inner_block][known] = value[known] / steps[known]
            continue
        seen = data[-_BLOCK:] if shape.rows >= _BLOCK else data[-shape.rows:]
        mean = data[:-len(seen)].reshape(-1, k) / np.maximum(seen, 1)[:, None]
        b = r["block"] * _BLOCK
        out[b:b + len(seen)] = np.where(seen[:, None] > 0, mean, out[b:b + len(seen)])
    return out, inner


def _score_rows(texts: DataFrame, vocabulary: Vocabulary, weights: tuple[np.ndarray, np.ndarray], shape: Shape) -> DataFrame:
    """One row per text with the sums over its frequent words (``tail`` false), and one per other word of it."""
    sent = texts.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (w, inner) = sent.value
        base_under = v.total + v.distinct + 1
        for batch in batches:
            words = words_of(batch)
            cls, sizes = v.classes(words.hash, words.suffix), words.sizes
            rows, target, doc, word, features = _tokens(words, cls, shape)
            found = v.find(words.hash)
            leaf = np.full(len(word), -1, np.int32)
            leaf[word >= 0] = v.leaves(found, cls)
            by_path = np.empty(len(target))
            for lo in range(0, len(target), shape.step):
                part = slice(lo, lo + shape.step)
                by_path[part] = _log_softmax(w, rows[part])[np.arange(len(target[part])), target[part]]
                by_path[part] += _log_inner(v.trees, inner, features[:, part], leaf[part], target[part], shape)
            n = len(sizes)
            c = np.full(len(word), v.ends, np.int64)
            c[word >= 0] = np.where(found >= 0, v.counts[found], -1) if len(v.counts) else -1
            sure = c >= 0
            score = np.bincount(doc, by_path, n) / np.log(10)
            base = np.bincount(doc[sure], np.log10((c[sure] + 1) / base_under), n)
            known = np.bincount(doc[sure], c[sure] > 0, n)
            rest, d = word[~sure], doc[~sure]
            order = np.lexsort((words.hash[rest], d))
            rest, d = rest[order], d[order]
            h = words.hash[rest]
            heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.empty(0, np.int64)
            times = np.diff(np.append(heads, len(h)))
            d, h, kind = d[heads], h[heads], cls[rest[heads]]
            ids, t = batch.column("i"), batch.column("t")
            take = pa.array(np.concatenate([np.arange(n), d]))
            zero = np.zeros(len(d))
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), t.take(take), pa.array(np.concatenate([t.to_numpy(), h.view(np.int64)])),
                 pa.array(np.concatenate([np.zeros(n, bool), np.ones(len(d), bool)])), pa.array(np.concatenate([np.zeros(n, np.int32), kind.astype(np.int32)])),
                 pa.array(np.concatenate([sizes + 1, times])), pa.array(np.concatenate([known.astype(np.int64), zero.astype(np.int64)])),
                 pa.array(np.concatenate([base, zero])), pa.array(np.concatenate([score, zero]))],
                names=["i", "t", "w", "tail", "cls", "n", "known", "base", "score"])

    kind = texts.schema["i"].dataType.simpleString()
    return texts.mapInArrow(run, f"i {kind}, t bigint, w bigint, tail boolean, cls int, n bigint, known bigint, base double, score double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per row of ``docs``.

    Texts whose ``crc32`` of the id as text falls in the fold are held out of training. Null text is empty: one token, its end. A null
    id has the empty text as its id. ``base_score`` is the add-one word count model, ``score`` this module's, both log10 of the whole
    text. Without training texts every count is zero and all classes are alike. Words are told apart by 64-bit hashes.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ident = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text).alias("t"), text.alias("text"), ident.alias("crc"))
    training = texts.filter(F.col("crc") % shape.folds != shape.fold)
    words, v = _learn_counts(training.select("text"), shape)
    weights = np.zeros((shape.rows, shape.classes), np.float32), np.zeros(shape.inner, np.float32)
    for k in range(shape.rounds):
        share = training.filter(F.floor(F.col("crc") / shape.folds) % shape.rounds == k)
        weights = _train_round(share.select("text"), v, weights, shape)
    rows = _score_rows(texts.select("i", "t", "text"), v, weights, shape)

    def per_class(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("cls") + 1)

    joined = rows.join(words.withColumnRenamed("w", "word"), (F.col("w") == F.col("word")) & F.col("tail"), "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    tail_base = F.col("n") * F.log10((c + 1) / F.lit(float(v.total + v.distinct + 1)))
    tail_score = F.col("n") * F.log10((c + 1) / per_class(np.maximum(v.trees.rest_total, 1)))
    summed = joined.groupBy("i", "t").agg(
        F.sum(F.when(F.col("tail"), 0).otherwise(1)).alias("copies"), F.sum(F.when(F.col("tail"), 0).otherwise(F.col("n"))).alias("n_tokens"),
        F.sum(F.when(F.col("tail"), F.when(c > 0, F.col("n")).otherwise(0)).otherwise(F.col("known"))).alias("n_known"),
        F.sum(F.when(F.col("tail"), tail_base).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(F.col("tail"), tail_score).otherwise(F.col("score"))).alias("score"))
    one = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    held = F.crc32(F.coalesce(F.col("i").cast("string"), F.lit("")).cast("binary")) % shape.folds == shape.fold
    return one.select(
        F.col("i").alias(id_col), held.alias("held_out"), F.expr("n_tokens div copies").alias("n_tokens"), F.expr("n_known div copies").alias("n_known"),
        F.lit(int(v.total)).cast("bigint").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))
