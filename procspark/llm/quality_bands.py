"""Quality rules: compression bands over whole documents and fixed chunks, beside a few base counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from procspark.llm.common import arrow_map, only, raw

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_MARKS = bytes(range(0x80, 0xC0))  # continuation bytes: what UTF-8 adds to code points


@dataclass(frozen=True)
class Bands:
    """Allowed ratios by length: ``(shorter than, lowest, highest)``.

    The lowest is for the text with one byte a letter, the highest for its UTF-8 bytes. A letter of two or three bytes says no less than one
    of one byte, so plain bytes would make clean Cyrillic, Greek or Chinese look repetitive; packed data is dense in its bytes. ASCII
    text has the same ratio both ways.

    Text of few letters and no repeats lies at 0.35 to 0.75; a text that repeats itself falls far below, random
    characters and packed data come close to 1. Short texts compress worse, so each length has its own limits.
    A chunk is judged by ``chunk_band`` in the same two ways; the document goes when chunks that stand for more than ``chunk_share``
    of its bytes fall outside. The last chunk ends with the text. The top lies under 6 bits a byte, which base64 can't go below and letters of prose don't reach.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (100, 0.0, 2.0), (400, 0.45, 0.92), (800, 0.45, 0.85), (1600, 0.44, 0.80), (3200, 0.43, 0.75), (6400, 0.405, 0.72),
        (12800, 0.395, 0.70), (25600, 0.38, 0.70), (float("inf"), 0.365, 0.70))
    chunk: int = 4096
    chunk_band: tuple[float, float] = (0.25, 0.74)
    chunk_share: float = 0.25


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == n:
        return 0
    ids = np.array([number[w] for w in words], dtype=np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, triple, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[triple] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def one_byte(text: bytes) -> bytes:
    """ASCII as it is, every other letter by its place among 128 code points: different for the letters of one alphabet. Cut letters go."""
    cp = np.frombuffer(text.decode(errors="ignore").encode("utf-32-le"), np.uint32)
    return np.where(cp < 128, cp, 128 + cp % 128).astype(np.uint8).tobytes()


class _Judge:
    def __init__(self, bands: Bands):
        self.bands, self.zstd = bands, zstandard.ZstdCompressor(level=bands.level)

    def ratios(self, data: bytes) -> tuple[float, float]:
        """``compressed / plain`` with one byte a letter, and of the bytes as they are."""
        whole = len(self.zstd.compress(data)) / len(data)
        if data.isascii():
            return whole, whole
        short = one_byte(data)
        return (len(self.zstd.compress(short)) / len(short) if short else 0.0), whole

    def verdict(self, text: bytes) -> tuple[float, float, bool]:
        """Ratio of the whole in bytes, share of bytes in chunks outside their band, kept."""
        if not text:
            return 0.0, 0.0, False
        letters, whole = self.ratios(text)
        n = len(text) if text.isascii() else len(text.translate(None, _MARKS))
        low = next(lo for end, lo, _ in self.bands.whole if n < end)
        high = next(hi for end, _, hi in self.bands.whole if len(text) < end)
        size = self.bands.chunk
        # (start, bytes it stands for): the last chunk ends with the text and stands for what the others leave
        pieces = [(i, size) for i in range(0, len(text) - size + 1, size)]
        if pieces and len(text) % size:
            pieces.append((len(text) - size, len(text) % size))
        a, b = self.bands.chunk_band
        measured = [(*self.ratios(text[i:i + size]), share) for i, share in pieces]
        outside = sum(share for p, r, share in measured if not (a <= p and r <= b)) / len(text) if pieces else 0.0
        return whole, outside, low <= letters and whole <= high and outside <= self.bands.chunk_share


def _measure(text: bytes, judge: _Judge) -> tuple:
    words = text.split()
    n, again = len(words), repeated_words(words)
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= len(text) - len(text.translate(None, _MARKS))
    failed = n < 50 or 100 * again > 50 * n
    whole, outside, fine = judge.verdict(text)
    return n, chars, len(_SYMBOLS.findall(text)), repeated_lines(text), again, failed, not failed and fine, whole, outside


FIELDS = (("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"),
          ("base_failed", "boolean"), ("kept", "boolean"), ("zstd_ratio", "double"), ("outside_share", "double"))
_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), bands: Bands = Bands()) -> DataFrame:
    """``keep`` columns and the measures of every row's whole text, with ``kept`` as the verdict.

    Null and empty texts have no words and fail. Equal rows get equal results, each once per row. No shuffle.
    """
    source = only(docs, *keep, text_col) if text_col not in keep else only(docs, *keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        judge = _Judge(bands)
        rows = [_measure(t, judge) for t in raw(batch, text_col)]
        cols = [batch.column(c) for c in keep]
        cols += [pa.array(list(v), _ARROW[t]) for v, (_, t) in zip(zip(*rows), FIELDS)]
        return pa.RecordBatch.from_arrays(cols, names=[*keep, *[f for f, _ in FIELDS]])

    types = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep]
    return arrow_map(source, run, ", ".join([*types, *[f"{f} {t}" for f, t in FIELDS]]))


def keep_good(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    source, names = docs, docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        judge = _Judge(bands)
        good = [_measure(t, judge)[6] for t in raw(batch, text_col)]
        return batch.filter(pa.array(good, pa.bool_()))

    return arrow_map(source.select(*[f"`{n}`" for n in names]), run, source.schema)
