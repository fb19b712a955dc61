"""Repeated passages by seed and extend.

A window is ``LENGTH`` consecutive words. Each window chooses one anchor: of its ``GRAM``-word grams the one with the smallest hash,
leftmost first (winnowing), so equal windows choose the same place inside themselves. The windows of one anchor follow each
other; the words they cover are the anchor extended both ways. Anchors are joined on their gram:

* occurrences whose whole extension is equal are one class, and all its members but the earliest repeat it entirely;
* where a gram has several classes, one member of each class has its text joined in and its windows compared one by one, which
  finds the repeats that end inside an extension.

Overlapping repeats of a document merge into maximal ones, which are removed. Texts are shuffled at most twice, anchors once;
equal occurrences of one batch are one row before the shuffle, and nothing pairs up the members of a group. A gram's rows
pass through a sorted stream that remembers one row, so a frequent gram needs no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procspark.llm.common import raw
from procspark.session import cut, shuffle_width

LENGTH, GRAM = 20, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers have inverses modulo 2^64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_hashes = _WordHashes()


def _numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


class _Spans:
    """Hashes of any span of a row of words, from sums of powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(n, _BASE, np.uint64)) if n else np.empty(0, np.uint64)
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)])
            self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _inverse(_BASE), np.uint64))])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.total[end] - self.total[start]) * self.back[start])


def anchors(sizes: np.ndarray, spans: _Spans, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: gram hash, anchor place, first and last window of every anchor."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    wide = length - gram + 1
    starts = np.arange(max(total - length + 1, 0))
    doc_end = np.repeat(ends, sizes)
    starts = starts[starts + length <= doc_end[:len(starts)]]
    none = np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), none, none, none
    at = np.arange(total - gram + 1)
    grams = spans.of(at, at + gram)
    place = np.empty(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, wide)
    for lo in range(0, len(starts), 1 << 18):
        part = starts[lo:lo + (1 << 18)]
        place[lo:lo + len(part)] = part + view[part].argmin(axis=1)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return grams[place[first]], place[first], starts[first], starts[last]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """For rows in order of precedence: whether each is the first with its keys."""
    order = np.lexsort(tuple(reversed(keys)))
    same = np.ones(len(order), bool)
    for k in keys:
        s = k[order]
        same[1:] &= s[1:] == s[:-1]
    if len(same):
        same[0] = False
    out = np.empty(len(order), bool)
    out[order] = ~same
    return out


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by document and start, overlapping or touching ones joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    shift = doc.astype(np.int64) << 40  # places of different documents can't meet
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], reach[np.append(heads[1:], len(doc)) - 1] - shift[heads]


class _Keyed:
    """How documents are named: by id, or where ids repeat by id and text hash."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        self.repeats = not docs.groupBy(F.col(f"`{id_col}`").alias("i")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        more = [F.xxhash64(text).alias("t")] if self.repeats else []
        self.docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("i"), *more, text.alias("text"))
        self.names = ["i", "t"] if self.repeats else ["i"]
        self.unique = self.docs.dropDuplicates(self.names) if self.repeats else self.docs
        self.types = ", ".join(f"{n} bigint" for n in self.names)

    def same(self, left: DataFrame, right: DataFrame):
        out = F.lit(True)
        for n in self.names:
            out = out & left[n].eqNullSafe(right[n])
        return out


def _ordered(names: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch in order of the documents' names; null is smallest, as in Spark's order."""
    return batch.take(pa.compute.sort_indices(batch, sort_keys=[(n, "ascending") for n in names], null_placement="at_start"))


def _rows(names: list[str], batch: pa.RecordBatch, doc: np.ndarray, **cols: np.ndarray) -> pa.RecordBatch:
    take = pa.array(doc)
    return pa.RecordBatch.from_arrays([*[batch.column(n).take(take) for n in names], *[pa.array(c) for c in cols.values()]],
                                      names=[*names, *cols])


def _seeds(keyed: _Keyed, length: int, gram: int) -> DataFrame:
    """``key..., h, ctx, span``: one row per anchor class of a batch, ``span`` = first window << 8 | windows - 1.

    Occurrences that repeat an earlier one of the batch are known to be repeats: they come as rows with a negative ``span``, which
    is the complement of the end, and the start as ``ctx``.
    """
    names = keyed.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _ordered(names, batch)
            words = [t.split() for t in raw(batch, "text")]
            sizes = np.array([len(w) for w in words], np.int64)
            spans = _Spans(np.concatenate([np.empty(0, np.uint64), *[_numbers(w) for w in words if w]]))
            h, place, lo, hi = anchors(sizes, spans, length, gram)
            if not len(h):
                continue
            begin = np.cumsum(sizes) - sizes
            doc = np.searchsorted(np.cumsum(sizes), lo, side="right")
            ctx = _mix(spans.of(lo, hi + length) + ((place - lo) << 8 | (hi - lo)).astype(np.uint64))
            first = _firsts(h, ctx)
            start = lo - begin[doc]
            again = ~first
            d, s, e = _merged(doc[again], start[again], (hi - begin[doc])[again] + length)
            known = _mix(d.astype(np.uint64) << np.uint64(32) ^ s.astype(np.uint64) ^ h[0])
            yield _rows(names, batch, np.concatenate([doc[first], d]),
                        h=np.concatenate([h[first], known]).view(np.int64),
                        ctx=np.concatenate([ctx[first].view(np.int64), s]),
                        span=np.concatenate([start[first] << 8 | (hi - lo)[first], ~e]))

    return keyed.unique.mapInArrow(run, f"{keyed.types}, h bigint, ctx bigint, span bigint")


def _resolve(names: list[str], length: int):
    """Over rows sorted by gram, class and place: repeats as ``start, stop``, and what needs a closer look with its ``h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h = last_ctx = None
        waiting: pa.RecordBatch | None = None  # the first class of the last gram, while it is its only one
        for batch in batches:
            span = batch.column("span").to_numpy()
            known = span < 0
            if known.any():
                part = batch.filter(pa.array(known))
                yield _out(part, part.column("ctx").to_numpy(), ~span[known], np.zeros(known.sum(), np.int64), np.zeros(known.sum(), bool))
                batch, span = batch.filter(pa.array(~known)), span[~known]
            if not len(span):
                continue
            h, ctx = batch.column("h").to_numpy(), batch.column("ctx").to_numpy()
            new_h = np.concatenate([[last_h is None or h[0] != last_h], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[last_ctx is None or ctx[0] != last_ctx], ctx[1:] != ctx[:-1]])
            lead = np.flatnonzero(new_c)
            several = ~new_h[lead]
            several[:-1] |= ~new_h[lead[1:]]
            look = lead[several]
            start, stop = span >> 8, (span >> 8) + (span & 255) + length
            closer = []
            if len(lead):
                if waiting is not None and not new_h[lead[0]]:
                    closer.append(waiting)
                waiting = None
                if new_h[lead[-1]] and not several[-1]:
                    waiting = batch.slice(int(lead[-1]), 1)
            if len(look):
                closer.append(batch.take(pa.array(look)))
            for part in closer:
                s = part.column("span").to_numpy()
                yield _out(part, s >> 8, (s >> 8) + (s & 255) + length, part.column("h").to_numpy(), np.ones(len(s), bool))
            again = ~new_c
            if again.any():
                yield _out(batch.filter(pa.array(again)), start[again], stop[again], np.zeros(again.sum(), np.int64), np.zeros(again.sum(), bool))
            last_h, last_ctx = h[-1], ctx[-1]

    def _out(part, start, stop, h, look):
        return pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(start), pa.array(stop), pa.array(h), pa.array(look)],
                                          names=[*names, "start", "stop", "h", "look"])

    return run


def _windows(names: list[str], length: int):
    """The single windows of the spans to look at, as rows like those of :func:`_seeds`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _ordered(names, batch)
            words = [t.split() for t in raw(batch, "text")]
            sizes = np.array([len(w) for w in words], np.int64)
            spans = _Spans(np.concatenate([np.empty(0, np.uint64), *[_numbers(w) for w in words if w]]))
            begin = np.cumsum(sizes) - sizes
            looks = batch.column("looks")
            counts = pa.compute.list_value_length(looks).to_numpy()
            flat = looks.flatten()
            doc = np.repeat(np.arange(len(counts)), counts)
            start, stop, h = (flat.field(n).to_numpy() for n in ("start", "stop", "h"))
            n = stop - start - length + 1
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            doc, h = np.repeat(doc, n), np.repeat(h, n)
            order = np.lexsort((at, doc))
            at, doc, h = at[order], doc[order], h[order]
            window = spans.of(at + begin[doc], at + begin[doc] + length).view(np.int64)
            first = _firsts(window, h)
            d, s, e = _merged(doc[~first], at[~first], at[~first] + length)
            yield _rows(names, batch, np.concatenate([doc[first], d]),
                        h=np.concatenate([window[first], _mix(d.astype(np.uint64) << np.uint64(32) ^ s.astype(np.uint64)).view(np.int64)]),
                        ctx=np.concatenate([h[first], s]), span=np.concatenate([at[first] << 8, ~e]))

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[_Keyed, DataFrame]:
    """The names of the documents, and ``key..., start, stop``: words covered by windows that also start earlier."""
    keyed = _Keyed(docs, id_col, text_col)
    width = shuffle_width(docs.sparkSession)
    out = f"{keyed.types}, start bigint, stop bigint, h bigint, look boolean"

    def streamed(rows: DataFrame) -> DataFrame:
        sorted_rows = rows.repartition(width, "h").sortWithinPartitions("h", "ctx", *keyed.names, "span")
        return sorted_rows.mapInArrow(_resolve(keyed.names, length), out)

    first = cut(streamed(_seeds(keyed, length, gram)))
    looks = first.filter("look").groupBy(*keyed.names).agg(F.collect_list(F.struct("start", "stop", "h")).alias("looks"))
    near = looks.join(keyed.unique, keyed.same(looks, keyed.unique)).select(*[looks[n] for n in keyed.names], keyed.unique["text"], looks["looks"])
    single = near.mapInArrow(_windows(keyed.names, length), f"{keyed.types}, h bigint, ctx bigint, span bigint")
    second = streamed(single).filter("not look")
    return keyed, first.filter("not look").unionByName(second).select(*keyed.names, "start", "stop")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id, text, n_words, n_removed``: the kept words joined by one space, one row per row of ``docs``.

    A word goes if a window over it has the same words as a window that starts earlier: in a document with a smaller id, or earlier in the
    same one. Null ids come before all others, null text is empty. Rows that share id and text are one document, returned as often as
    it is there; rows that share only the id are ordered by text hash. Texts shorter than a window are kept.
    Words and windows are compared by 64-bit hashes of their bytes, two independent ones per window.
    """
    keyed, spans = repeats(docs, id_col, text_col, length, gram)
    # a document has no more spans than words
    gone = spans.groupBy(*keyed.names).agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    full = keyed.docs.join(gone, keyed.same(keyed.docs, gone), "left").select(keyed.docs["i"], keyed.docs["text"], gone["gone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for text, cuts in zip(raw(batch, "text"), batch.column("gone").to_pylist()):
                words = text.split()
                if cuts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [c["start"] for c in cuts], 1)
                    np.add.at(edge, [c["stop"] for c in cuts], -1)
                    stays = np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()
                    texts.append(b" ".join([words[i] for i in stays]))
                    n_removed.append(len(words) - len(stays))
                else:
                    texts.append(b" ".join(words))
                    n_removed.append(0)
                n_words.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                names=["i", "text", "n_words", "n_removed"])

    return full.mapInArrow(run, "i bigint, text string, n_words bigint, n_removed bigint").withColumnRenamed("i", id_col)
