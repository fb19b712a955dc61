"""Benchmark items inside documents: size-partitioned MinHash containment search, verified on exact shingles.

Items are partitioned by their number of shingles. An item of ``n`` shingles that a document contains to the share ``t`` misses
at most ``(1 - t) n`` of them, so of its ``k`` smallest hashes, one more than the largest number of misses in its size class, at least
one is in the document, however long that is. These minima are the index; a document meets an item where it has one
of them and enough shingles of its own. Then all shingles of the pair decide.

Documents are not shuffled. A bitmap of fixed size holds all item shingles; a document's shingles that are not in it can't
count for any item and end in their task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procspark.llm.common import only, raw
from procspark.session import cut, lookup

WORDS, SHARE = 5, 0.8
_BITS = 24  # the bitmap has 2^24 bits, 2 MB, whatever the number of items


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the runs of ``words`` words, A-Z in lower case; a shorter text is one run, no words are none."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b - 1]) for a, b in zip(starts, starts[words:])], np.uint64))


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``item, s, n``: the distinct shingles of every item and their number.

    Items without words, or without an id, are left out. Rows that share an id are one item with the shingles of all.
    """
    source = only(items.filter(F.col(f"`{id_col}`").isNotNull()), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t, words) for t in raw(batch, text_col)]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            s = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(s)], names=["item", "s"])

    rows = source.mapInArrow(run, f"item {source.schema[id_col].dataType.simpleString()}, s bigint").distinct()
    return rows.join(rows.groupBy("item").agg(F.count("*").alias("n")), "item")


def sketch(shingles: DataFrame, share: float = SHARE) -> DataFrame:
    """``item, s, n``: per item the smallest hashes, as many as its size class (powers of two) needs to be certain."""
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    need = F.floor((1 - share) * largest + 1e-9) + 1
    # an item's shingles meet in one row; it is a short text
    kept = shingles.groupBy("item", "n").agg(F.array_sort(F.collect_list("s")).alias("all")).select("item", "n", F.explode(F.slice("all", 1, need.cast("int"))).alias("s"))
    return kept.select("item", "s", "n")


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """One bit per value of the shingles' lower bits. At most 2^18 words come to the driver."""
    place = F.pmod(F.col("s"), F.lit(1 << _BITS))
    words = shingles.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(s, {1 << _BITS}) & 63 as int))")).alias("bits")).collect()
    out = np.zeros(1 << (_BITS - 6), np.uint64)
    if words:
        out[[r["w"] for r in words]] = np.array([r["bits"] for r in words], np.int64).view(np.uint64)
    return out


def document_hits(docs: DataFrame, shingles: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``i, t, size, s``: a document's id and text hash, its number of distinct shingles, and those that an item may have."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text).alias("t"), text.alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(shingles).tobytes())
    low = np.uint64((1 << _BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint64)
        for batch in batches:
            row, size, kept = [], [], []
            for k, t in enumerate(raw(batch, "text")):
                s = shingle_hashes(t, words)
                place = s & low
                s_in = s[table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1]
                if len(s_in):
                    row.append(np.full(len(s_in), k))
                    size.append(np.full(len(s_in), len(s)))
                    kept.append(s_in)
            if kept:
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(size)),
                                                  pa.array(np.concatenate(kept).view(np.int64))], names=["i", "t", "size", "s"])

    return source.mapInArrow(run, f"i {source.schema['i'].dataType.simpleString()}, t bigint, size bigint, s bigint")


def _search(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, words: int, share: float) -> DataFrame:
    shingles = cut(item_shingles(items, item_col, item_text, words))
    # repeated rows are one document here; a hit's shingle is joined exactly below
    hits = cut(document_hits(docs, shingles, id_col, text_col, words).distinct())
    name = F.struct("i", "t", "item").alias("pair")  # a struct equals another also where its id is null
    pairs = hits.join(sketch(shingles, share), "s").filter(F.col("size") >= F.col("n") * share - 1e-9).select(name).distinct()
    counted = hits.join(shingles, "s").select(name, "n").join(pairs, "pair", "left_semi").groupBy("pair", "n").agg(F.count("*").alias("n_shared")).select("pair.*", "n", "n_shared")
    return counted.filter(F.col("n_shared") >= F.col("n") * share - 1e-9)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", words: int = WORDS, share: float = SHARE) -> DataFrame:
    """``id, item, n_shared, n_shingles, containment``: every pair of a document and an item it contains to ``share`` or more.

    Null texts are empty and contain nothing. Equal rows are reported once; rows that share only an id each for themselves. Documents with a null
    id are searched and reported with it. Items shorter than a shingle match only documents that are the same few words.
    Empty tables give an empty result.
    """
    found = _search(docs, items, id_col, text_col, item_col, item_text, words, share)
    return found.select(F.col("i").alias(id_col), F.col("item").alias(item_col), "n_shared", F.col("n").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          words: int = WORDS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns, as often as they are there."""
    found = _search(docs, items, id_col, text_col, item_col, item_text, words, share)
    # only keys travel: sent to the texts while they are few, else joined
    bad = lookup(found.select(F.struct("i", "t").alias("key")).distinct())
    key = F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("t"))
    return docs.join(bad, key == bad["key"], "left_anti")
