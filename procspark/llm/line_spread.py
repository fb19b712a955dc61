"""Boilerplate lines by the number of distinct sites they stand on.

Lines are compared by the 64-bit hash of their trimmed text. Each line hash gets a HyperLogLog sketch of its sites; sketches
of map tasks merge in the aggregation, so a line that stands in a third of all documents is one small sketch per
task. Lines whose estimate lies near the threshold are counted exactly.

A document most of whose text is widely spread lines is itself a copy of a spread document. It is left whole: that is a
case for near-duplicate removal, which keeps one of the copies.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procspark.llm.common import arrow_map, only, raw
from procspark.session import cut

MIN_SITES = 10
MARGIN = 0.15  # more than six standard errors of a sketch with 2^12 registers
FEW_LINES = 100_000
_BLANK = " \t\n\x0b\f\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def line_hash(line: Column) -> Column:
    return F.xxhash64(_trimmed(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """``h, site``: one row per line with a character other than white space; documents without a site share the site ''."""
    rows = docs.select(F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("")).alias("site"), F.explode(_lines(F.col(f"`{text_col}`"))).alias("line"))
    return rows.filter(F.length(_trimmed(F.col("line"))) > 0).select(line_hash(F.col("line")).alias("h"), F.xxhash64("site").alias("site"))


def spread_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """``h``: hashes of the lines that stand on at least ``min_sites`` distinct sites."""
    lines = cut(occurrences(docs, text_col, site_col))
    # a line whose first and last site are the same stands on one site and needs no sketch
    several = lines.groupBy("h").agg(F.min("site").alias("a"), F.max("site").alias("b")).filter("a <> b").select("h")
    wide = lines.join(several, "h", "left_semi") if min_sites > 1 else lines
    estimated = cut(wide.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", 12)).alias("sites")).filter(F.col("sites") >= min_sites * (1 - margin)))
    sure = F.col("sites") > min_sites * (1 + margin)
    near = estimated.filter(~sure).select("h")
    exact = lines.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("h")
    return cut(estimated.filter(sure).select("h").unionByName(exact))


def _stripped(text: bytes, spread: frozenset[int], most: float) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    bare = [line.strip(_BLANK.encode()) for line in lines]
    n = sum(map(bool, bare))
    hit = [bool(b) and xxhash.xxh64_intdigest(b, 42) in spread for b in bare]
    if not any(hit):
        return text, n, 0
    gone = sum(len(line.decode()) for line, h in zip(lines, hit) if h)
    if gone > len(text.decode()) * most:
        return text, n, 0
    return b"\n".join([line for line, h in zip(lines, hit) if not h]), n, sum(hit)


def _strip_in_place(docs: DataFrame, spread: frozenset[int], id_col: str, text_col: str, keep: list[str], most: float) -> DataFrame:
    """With few spread lines: their hashes go to the tasks that read the texts."""
    source = only(docs, id_col, *keep, text_col)
    names = [id_col, *keep, text_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_stripped(t, spread, most) for t in raw(batch, text_col)]
        cols = [*[batch.column(k) for k in range(len(names) - 1)], pa.array([f[0] for f in found], pa.binary()).cast(pa.string()),
                pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[*names[:-1], "text*", "n_lines*", "n_removed*"])

    fields = [T.StructField("text*", T.StringType()), T.StructField("n_lines*", T.LongType()), T.StructField("n_removed*", T.LongType())]
    return arrow_map(source, run, T.StructType([*source.schema.fields[:-1], *fields]))


def _strip_by_join(docs: DataFrame, spread: DataFrame, id_col: str, text_col: str, keep: list[str], most: float) -> DataFrame:
    """With many: every document's own spread lines are joined to it."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ident = F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text).alias("t"))
    rows = docs.select(ident.alias("ident"), F.explode(F.array_distinct(F.transform(
        F.filter(_lines(text), lambda x: F.length(_trimmed(x)) > 0), line_hash))).alias("h"))
    # bounded by the lines of the document itself
    marked = rows.join(spread, "h").distinct().groupBy("ident").agg(F.collect_set("h").alias("spread"))
    row = F.struct(F.col(f"`{id_col}`").alias("id"), text.alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    joined = docs.select(row.alias("d"), ident.alias("ident")).join(marked, "ident", "left")
    lines = _lines(F.col("d.text"))
    stays = F.filter(lines, lambda x: ~F.array_contains("spread", line_hash(x)))
    judged = joined.select("d", lines.alias("lines"), F.when(F.col("spread").isNull(), lines).otherwise(stays).alias("stays"))
    gone = F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)) - F.aggregate("stays", F.lit(0), lambda a, x: a + F.length(x))
    judged = judged.withColumn("take", gone <= F.length("d.text") * most)
    out = F.when(F.col("take"), F.array_join("stays", "\n")).otherwise(F.col("d.text"))
    real = F.size(F.filter("lines", lambda x: F.length(_trimmed(x)) > 0)).cast("bigint")
    removed = F.when(F.col("take"), F.size("lines") - F.size("stays")).otherwise(0).cast("bigint")
    return judged.select(F.col("d.id").alias(id_col), *[F.col(f"d.k{i}").alias(c) for i, c in enumerate(keep)],
                         out.alias("text*"), real.alias("n_lines*"), removed.alias("n_removed*"))


def strip_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", keep: tuple[str, ...] = (),
                      min_sites: int = MIN_SITES, most: float = 0.5, few: int = FEW_LINES) -> DataFrame:
    """``id, keep..., text, n_lines, n_removed``: one row per row of ``docs``, its spread lines taken out.

    Lines are joined again by one line feed; blank lines stay. Null text is empty. If spread lines hold more than ``most``
    of a text's characters, nothing is removed from it. Rows with a null id, and repeated rows, are handled alike. An empty table gives an
    empty result. Up to ``few`` spread lines, their hashes are sent to the tasks; more are joined. Both give the same rows. A kept
    column named ``n_lines`` or ``n_removed`` stands instead of the count.
    """
    rest = [c for c in keep if c not in (id_col, text_col)]
    spread = spread_lines(docs, text_col, site_col, min_sites)
    some = [r["h"] for r in spread.limit(few + 1).collect()]
    if len(some) > few:
        found = _strip_by_join(docs, spread, id_col, text_col, rest, most)
    else:
        found = _strip_in_place(docs, frozenset(h % 2**64 for h in some), id_col, text_col, rest, most)
    counts = [F.col(f"`{c}*`").alias(c) for c in ("n_lines", "n_removed") if c not in (id_col, text_col, *rest)]
    return found.select(*[F.col(f"`{c}`") for c in (id_col, *rest)], F.col("`text*`").alias(text_col), *counts)
