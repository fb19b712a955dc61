"""Contract text: clause-sized chunks and duplicates by content."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunk sizes in characters, and where to cut, from the strongest boundary to the weakest.
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK = 600, 80, 40
BOUNDARIES = [
    r"\n(?=\d+\.\d*\s)",
    r"\n(?=[A-Z][A-Z ]{4,}\n)",
    r"\n\n",
    r"\n",
    r"\. ",
    r" ",
]
_CUTS = [re.compile(b) for b in BOUNDARIES]


def _pack(spans: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Fill windows of adjacent spans; the next window keeps trailing spans up to the overlap."""
    first, start, end = 0, None, None
    for i, (lo, hi) in enumerate(spans):
        if start is not None and hi - start > size:
            yield start, end
            while start < end and (end - start > overlap or hi - start > size):
                first += 1
                start = spans[first][0] if first < i else end
        if start is None or start == end:
            first, start = i, lo
        end = hi
    if start is not None:
        yield start, end


def _spans(text: str, lo: int, hi: int, level: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunk spans of ``text[lo:hi]``: cut at the strongest boundary present, pack the small pieces, and cut the
    large ones at weaker boundaries. A piece begins with the boundary it was cut at."""
    while level < len(_CUTS) and not _CUTS[level].search(text, lo, hi):
        level += 1
    if level == len(_CUTS):
        yield lo, hi
        return
    marks = [lo, *[m.start() for m in _CUTS[level].finditer(text, lo, hi) if m.start() > lo], hi]
    run: list[tuple[int, int]] = []
    for a, b in zip(marks, marks[1:]):
        if b - a < size:
            run.append((a, b))
            continue
        yield from _pack(run, size, overlap)
        run = []
        if level + 1 < len(_CUTS):
            yield from _spans(text, a, b, level + 1, size, overlap)
        else:
            yield a, b
    yield from _pack(run, size, overlap)


def chunks_of(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, shortest: int = MIN_CHUNK) -> list[tuple[int, int, str]]:
    """``(chunk_index, start_index, text)``; short chunks are dropped after numbering."""
    out, number = [], 0
    for lo, hi in _spans(text, 0, len(text), 0, size, overlap):
        piece = text[lo:hi]
        body = piece.strip()
        if not body:
            continue
        if len(body) >= shortest:
            out.append((number, lo + len(piece) - len(piece.lstrip()), body))
        number += 1
    return out


def chunk_text(df: DataFrame, id_col: str, text_col: str, extra: list[str] = (), size: int = CHUNK_SIZE,
               overlap: int = CHUNK_OVERLAP, shortest: int = MIN_CHUNK) -> DataFrame:
    """One row per chunk: id, extra columns, chunk_index, start_index, text. Narrow: no shuffle."""
    keep = [id_col, *extra]
    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [chunks_of(t, size, overlap, shortest) for t in pdf[text_col].fillna("")]
            rows = pdf[keep].loc[pdf.index.repeat([len(f) for f in found])].reset_index(drop=True)
            flat = [c for f in found for c in f]
            rows["chunk_index"] = pd.Series([c[0] for c in flat], dtype="int32")
            rows["start_index"] = pd.Series([c[1] for c in flat], dtype="int32")
            rows["text"] = pd.Series([c[2] for c in flat], dtype="object")
            yield rows

    return df.select(*keep, text_col).mapInPandas(run, f"{types}, chunk_index int, start_index int, text string")


def content_hash_dedup(df: DataFrame, text_col: str, order: str, stored: DataFrame | None = None) -> DataFrame:
    """The first row of each content, minus contents stored already. Only hashes are compared; copies of one
    content are reduced before the shuffle and texts are joined back by the key of the row that stays."""
    hashed = df.select(order, F.sha2(F.col(text_col), 256).alias("file_hash"))
    first = hashed.groupBy("file_hash").agg(F.min(order).alias(order))
    if stored is not None:
        first = first.join(stored.select("file_hash"), "file_hash", "left_anti")
    return df.join(first, order)
