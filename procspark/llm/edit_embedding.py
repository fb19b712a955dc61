"""Document fingerprints from a randomised edit embedding.

All texts take the same random walk (Chakraborty, Goldenberg and Koucky, 2016): a pointer starts at the first character; step ``j``
emits the character under the pointer and moves on if the bit ``h_j(character)`` is 1. After an edit, two walks fall into step again
within a number of steps that depends on the edit alone, so few edits leave the emitted strings equal in all but few places: edit
distance becomes Hamming distance.

A fingerprint is a sample of the emitted string. Each of its ``SLOTS`` has a random priority for every step, the same for all
texts, and takes the character emitted at the step of highest priority; texts of nearly equal length thus sample the same steps. The share of
equal slots is the likeness of two texts. Bands of ``BAND`` slots are join keys: texts of a likeness of 0.8 share one of the 32 with a chance
of 0.997; what meets is verified on all slots and, for pairs of documents, by edit distance.

The walk is kept as a table: for a step and a class of characters, the step at which the pointer moves on. A text costs one table
look-up for each character. The bits repeat after ``_PERIOD`` steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procspark.llm.common import arrow_map, only, raw
from procspark.operators.pairs import pair_tiles
from procspark.session import cut, shuffle_width

SLOTS, BAND = 256, 8
LIKENESS = 0.8
_PERIOD, _CLASSES = 1024, 32
_LADDER = 96  # steps of highest priority so far: some ln(2^62) of them, and to spare


def _noise(a: np.ndarray, salt: int) -> np.ndarray:
    """Well mixed 64-bit numbers."""
    x = (np.asarray(a, np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


@cache
def walk_bits() -> np.ndarray:
    """``h_j(class)`` for all steps of a period."""
    return (_noise(np.arange(_PERIOD * _CLASSES), 11) >> np.uint64(40) & np.uint64(1)).astype(bool).reshape(_PERIOD, _CLASSES)


@cache
def walk_table() -> list[int]:
    """``[step * _CLASSES + class]``: the step, times ``_CLASSES``, at which a character that comes up at ``step`` is followed by the next."""
    bits = walk_bits()
    step = np.arange(2 * _PERIOD)[:, None]
    moves = np.where(np.concatenate([bits, bits]), step, 4 * _PERIOD)
    first = np.minimum.accumulate(moves[::-1], axis=0)[::-1][:_PERIOD]
    one = [s * _CLASSES for s in range(_PERIOD)]  # one object per step, so that the table stays in the processor's cache
    return [one[s] for s in ((first + 1) % _PERIOD).ravel().tolist()]


@cache
def ladders() -> list[np.ndarray]:
    """For each slot the steps that have the highest priority of all up to them, ascending.

    If step ``p`` leads, the next leader comes after ``x`` with a chance of ``(p + 1) / (x + 1)``; so the leaders themselves can be drawn.
    """
    u = (_noise(np.arange(SLOTS * _LADDER), 23) >> np.uint64(11)).astype(float).reshape(SLOTS, _LADDER) / 2.0 ** 53
    out = []
    for row in u.tolist():
        steps, p = [0], 0
        for x in row:
            p = int((p + 1) / max(x, 1e-12))
            if p >= 1 << 62:
                break
            if p > steps[-1]:
                steps.append(p)
        out.append(np.array(steps, np.int64))
    return out


@cache
def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """The class and the slot byte (1 to 255) of a character, by the lower 16 bits of its code point."""
    points = np.arange(1 << 16)
    return (_noise(points, 5) % np.uint64(_CLASSES)).astype(np.uint8), (1 + _noise(points, 7) % np.uint64(255)).astype(np.uint8)


def codes(text: bytes) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def walk(points: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """``starts[i]``: the step at which character ``i`` comes up; one more entry for the end. Given the starts of a prefix, goes on from there."""
    starts = np.zeros(1, np.int64) if starts is None else starts
    rest = points[len(starts) - 1:]
    classes = character_tables()[0][rest & 0xFFFF].tobytes()
    table = walk_table()
    now = int(starts[-1] % _PERIOD) * _CLASSES
    places = np.array([now, *[now := table[now + c] for c in classes]], np.int64) // _CLASSES
    stays = np.diff(places) % _PERIOD
    stays[stays == 0] = _PERIOD
    return np.concatenate([starts, starts[-1] + np.cumsum(stays)])


@cache
def _rungs() -> tuple[np.ndarray, np.ndarray]:
    """All ladders as one table, unused rungs beyond every step."""
    wide = np.full((SLOTS, max(map(len, ladders()))), np.iinfo(np.int64).max, np.int64)
    for row, steps in zip(wide, ladders()):
        row[:len(steps)] = steps
    return wide, np.arange(SLOTS)


def sampled(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fingerprint as ``SLOTS`` bytes: 1 to 255 from the sampled characters, all 0 for an empty text."""
    if not len(points):
        return np.zeros(SLOTS, np.uint8)
    wide, slot = _rungs()
    step = wide[slot, np.count_nonzero(wide < starts[-1], axis=1) - 1]
    at = np.searchsorted(starts, step, side="right") - 1
    return character_tables()[1][points[at] & 0xFFFF]


def fingerprint(text: bytes) -> np.ndarray:
    points = codes(text)
    return sampled(points, walk(points))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def share_band(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the two would meet under a band's key."""
    return bool((a == b).reshape(-1, BAND).all(axis=1).any())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (binary), one row per row; null text counts as empty. Equal texts have equal fingerprints."""
    source = only(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array([fingerprint(t).tobytes() for t in raw(batch, text_col)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), fp], names=[id_col, "fp"])

    return arrow_map(source, run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, fp binary")


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one column of the table at a time as bits of one number (Myers 1999, Hyyro 2003)."""
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        score += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(xv | up)) & full, up & xv & full
    return score


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS) -> DataFrame:
    """``a, b, likeness, edits``: pairs of documents with different texts, ``a < b``, that share a band, whose likeness reaches ``least`` and whose
    edit distance is at most ``1 - least`` of the longer text.

    Equal texts are one document, named by its smallest id; rows without an id or without a character have no pairs. Keys that many documents
    share are joined in tiles; the pairs are the result and as many as there are.
    """
    rows = only(docs, id_col, text_col).filter(F.col(f"`{id_col}`").isNotNull() & (F.length(F.col(f"`{text_col}`")) > 0))
    first = rows.groupBy(F.col(f"`{text_col}`").alias("text")).agg(F.min(f"`{id_col}`").alias("id"))
    texts = cut(first)
    prints = cut(fingerprints(texts, "id", "text"))
    n = SLOTS // BAND

    def band(b):
        return F.struct(b.alias("band"), F.substring("fp", b * BAND + 1, F.lit(BAND)).alias("key"))

    keyed = prints.select("id", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), band)).alias("k")).select("id", "fp", "k.band", "k.key")
    met = pair_tiles(keyed, ["band", "key"], "id", ["fp"]).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.col("l_fp").alias("fa"), F.col("r_fp").alias("fb"))

    id_type = texts.schema["id"].dataType.simpleString()

    def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in (2, 3))
        share = (x == y).mean(axis=1)
        keep = pa.array(share >= least)
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(share[share >= least])], names=["a", "b", "likeness"])

    close = cut(arrow_map(met, likely, f"a {id_type}, b {id_type}, likeness double").distinct())
    whole = close.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def verified(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, share, x, y = (c.to_pylist() for c in batch.columns)
        out = [(i, j, s, d) for i, j, s, p, q in zip(a, b, share, x, y) if (d := edit_distance(p, q)) <= (1 - least) * max(len(p), len(q)) + 1e-9]
        return pa.RecordBatch.from_pylist([dict(zip("abse", r)) for r in out], schema=pa.schema(
            [("a", batch.schema.field(0).type), ("b", batch.schema.field(1).type), ("s", pa.float64()), ("e", pa.int64())])).rename_columns(["a", "b", "likeness", "edits"])

    return arrow_map(whole.select("a", "b", "likeness", "x", "y"), verified, f"a {id_type}, b {id_type}, likeness double, edits bigint")


# --- every document with its edited text and its neighbour ------------------------------------------------------------------------

_SLICE_SAMPLES = 20


def _in_order(rows: DataFrame) -> DataFrame:
    """Documents in slices of a falling id (null last, then by digest of the text), each slice followed by the first document after it.

    Slices are cut at keys of sampled rows, so that a row can tell by itself that it starts one and must also be sent to the slice before.
    The last slice is followed by the first row of all. Only keys are sampled: some 20 for each task of the shuffle.
    """
    spark = rows.sparkSession
    width = shuffle_width(spark)
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    falling = [F.col("id").desc_nulls_last(), F.col("tie").asc()]
    keys = keyed.select("id", "tie")
    head = keys.orderBy(*falling).limit(1)
    tried = keys.orderBy(F.rand(1)).limit(width * _SLICE_SAMPLES)
    place = lambda r: (r.id is None, 0 if r.id is None else ~r.id, r.tie)
    found = {place(r): r for r in tried.collect()}
    first = head.first()
    if first is None:
        return keyed.select("id", "text", "tie", F.lit(0).alias("slice"), F.lit(False).alias("guest"))
    inner = sorted(k for k in found if k > place(first))
    bounds = [place(first)] + inner[_SLICE_SAMPLES - 1::_SLICE_SAMPLES][:width - 1]
    n = len(bounds)
    # every bound as a literal: a row's slice is the number of later bounds at or before it
    literal = F.array(*[F.struct(F.lit(b[0]).alias("none"), F.lit(b[1]).cast("bigint").alias("fall"), F.lit(b[2]).alias("tie")) for b in bounds])
    own = F.struct(F.col("id").isNull().alias("none"), F.coalesce(F.bitwise_not("id"), F.lit(0)).cast("bigint").alias("fall"), F.col("tie").alias("tie"))
    marked = keyed.withColumn("own", own).withColumn("slice", F.size(F.filter(literal, lambda b: b <= F.col("own"))) - 1)
    starts = F.array_contains(literal, F.col("own"))
    stays = F.struct(F.col("slice"), F.lit(False).alias("guest"))
    goes = F.struct(F.pmod(F.col("slice") - 1, F.lit(n)).alias("slice"), F.lit(True).alias("guest"))
    sent = marked.withColumn("to", F.explode(F.when(starts, F.array(stays, goes)).otherwise(F.array(stays))))
    dealt = sent.select("id", "text", "tie", F.col("to.slice").alias("slice"), F.col("to.guest").alias("guest"))
    return dealt.repartitionById(n, F.col("slice")).sortWithinPartitions("slice", "guest", *falling)


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how near it is to the edited text and to the next document.

    The next document is the one with the next smaller id; after the last comes the first; a single document is its own next. The edited text
    is the document with its last third (rounded down) replaced by as many characters from the start of the next one, or all it has. Rows with equal
    ids are ordered by a hash of their text, rows with a null id come last; null text counts as empty. ``meets_edited`` tells whether the
    document and its edited text share a band. The edited text shares the walk of the two thirds that stay.
    """
    rows = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "meets_edited"]
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("meets_edited", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document whose next is still to come: id, code points, starts, fingerprint
        done_slice = None
        for batch in batches:
            out = []
            ids, slices, guests = (batch.column(c).to_pylist() for c in (0, 3, 4))
            for number, text, part, guest in zip(ids, raw(batch, "text"), slices, guests):
                if guest and part == done_slice:
                    continue  # a repeated row at the bound
                points = codes(text)
                starts = walk(points)
                print_ = sampled(points, starts)
                if held is not None:
                    out.append(_edited(*held, points, print_))
                held = None if guest else (number, points, starts, print_)
                done_slice = part if guest else None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    found = _in_order(rows).mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                            "near_edited double, near_next double, meets_edited boolean")
    return found.select(F.col("id").alias(id_col), *names)


def _edited(number: int | None, points: np.ndarray, starts: np.ndarray, print_: np.ndarray, other: np.ndarray, other_print: np.ndarray) -> dict:
    n = len(points)
    stays = n - n // 3
    new = np.concatenate([points[:stays], other[:n // 3]])
    new_print = sampled(new, walk(new, starts[:stays + 1]))
    return {
        "id": number, "n_chars": n, "edited_sha256": sha256(new.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest(),
        "fingerprint": print_.tobytes().hex(), "edited_fingerprint": new_print.tobytes().hex(),
        "near_edited": likeness(print_, new_print), "near_next": likeness(print_, other_print), "meets_edited": share_band(print_, new_print)}
