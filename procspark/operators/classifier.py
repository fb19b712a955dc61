"""Second stage: regularised second-order boosted trees on the forest score and the raw features.

Values become bins once. A level of a tree is one pass over the rows: tasks add up first and second derivatives per (node,
column, bin), Spark adds up the tasks' sums, and the driver picks the splits from at most nodes x columns x bins numbers.
Derivatives are summed in fixed point, so the trees do not depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procspark.session import cut

TASK_ROWS = 20_000
# Fixed values of the training set-up.
ROUNDS, DEPTH, STEP, ROW_SHARE, COLUMN_SHARE, LEAF_HESSIAN, L1, L2 = 400, 4, 0.05, 0.8, 0.8, 5.0, 0.1, 2.0
BINS, ACCURACY = 64, 10_000
UNIT = float(1 << 24)  # fixed point of the summed derivatives
FROZEN_ROUNDS = 25  # rounds after which margins are written, so that a pass evaluates at most so many trees


def stratified_split(df: DataFrame, key: str, label: str = "label", test_share: float = 0.20, seed: int = 42) -> DataFrame:
    """Mark ``is_test`` by a hash of the key: the same share of either label, the same rows on any cluster."""
    u = F.pmod(F.xxhash64(F.col(key), F.col(label), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return df.withColumn("is_test", u < test_share)


@dataclass
class Boosted:
    """Trees as heaps: node ``i`` has the children ``2i + 1`` and ``2i + 2``; ``feature`` is -1 at a leaf, whose ``value`` counts."""

    trees: list[dict]
    cols: list[str]
    depth: int = DEPTH


def bin_edges(df: DataFrame, cols: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Per column at most ``bins - 1`` of its values as edges, from a mergeable sketch; a value up to an edge lies below it."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, ACCURACY).alias(c) for c in cols]).first()
    return {c: sorted({v for v in row[c] or [] if v == v}) for c in cols}


def _places(bins: np.ndarray, tree: dict, depth: int) -> np.ndarray:
    """The node in which every row of ``bins`` ends."""
    feature, edge = np.array(tree["feature"]), np.array(tree["bin"])
    node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        below = bins[rows, np.maximum(f, 0)] <= edge[node]
        node = np.where(f < 0, node, 2 * node + np.where(below, 1, 2))
    return node


def _drawn(key: np.ndarray, round_: int, share: float) -> np.ndarray:
    """Rows that take part in a round: a hash of the row's key and the round."""
    if share >= 1:
        return np.ones(len(key), dtype=bool)
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64(round_ + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x < np.uint64(int(share * 2**64))


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return (bins, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "margin", "k")))


def _derivatives(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * w * UNIT), np.rint(np.maximum(p * (1 - p), 1e-16) * w * UNIT)


def _totals(bins: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, here: np.ndarray, nodes: list[int]) -> np.ndarray:
    """Both derivatives of the rows ``here``, added up by node, column and bin."""
    width = bins.shape[1]
    total = np.zeros((2, len(nodes), width, BINS))
    for i, n in enumerate(nodes):
        rows = np.flatnonzero(here & (at == n))
        cells = (bins[rows] + np.arange(width) * BINS).ravel()
        for kind, values in enumerate((g, h)):
            total[kind, i] = np.bincount(cells, weights=np.repeat(values[rows], width), minlength=width * BINS).reshape(width, BINS)
    return total


def _sums(data: DataFrame, trees: list[dict], tree: dict, nodes: list[int], width: int, depth: int, round_: int, row_share: float) -> pd.DataFrame:
    """``node, col, bin, g, h`` summed over the round's rows in ``nodes`` of the growing ``tree``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(nodes), width, BINS))
        for batch in batches:
            bins, y, w, margin, key = _columns(batch, width)
            for t in trees:
                margin = margin + np.array(t["value"])[_places(bins, t, depth)]
            total += _totals(bins, *_derivatives(y, w, margin), _places(bins, tree, depth), _drawn(key, round_, row_share), nodes)
        i, c, b = np.nonzero((total[0] != 0) | (total[1] != 0))
        cols = [np.array(nodes)[i].astype(np.int32), c.astype(np.int32), b.astype(np.int32), total[0, i, c, b].astype(np.int64), total[1, i, c, b].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["node", "col", "bin", "g", "h"])

    parts = data.mapInArrow(add, "node int, col int, bin int, g bigint, h bigint")
    return parts.groupBy("node", "col", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()


def _soft(g: np.ndarray | float) -> np.ndarray | float:
    """The gradient sum less the absolute penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - L1, 0.0)


def _gain(g, h):
    return _soft(g) ** 2 / (h + L2)


def _best(g: np.ndarray, h: np.ndarray, allowed: list[int]) -> tuple[int, int] | None:
    """Column and bin of the best split of a node by its (columns x bins) sums, of equals the first; none without gain."""
    best, found = 1e-6, None
    for c in allowed:
        gl, hl = np.cumsum(g[c]), np.cumsum(h[c])
        gr, hr = gl[-1] - gl, hl[-1] - hl
        gain = np.where((hl >= LEAF_HESSIAN) & (hr >= LEAF_HESSIAN), _gain(gl, hl) + _gain(gr, hr) - _gain(gl[-1], hl[-1]), -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, found = float(gain[b]), (c, b)
    return found


def fit(df: DataFrame, cols: list[str], label: str = "label", rounds: int = ROUNDS, seed: int = 42, key: str | None = None,
        depth: int = DEPTH, step: float = STEP, row_share: float = ROW_SHARE, column_share: float = COLUMN_SHARE,
        edges: dict[str, list[float]] | None = None) -> Boosted:
    """Positives weigh as much as negatives together; the weights come from one aggregate.

    A round draws rows by a hash of ``key`` (without one, of the values) and columns by the seed. Rows without a label are left out;
    a missing value or NaN lies above all edges. Without rows the model is one that says one half.
    """
    df = df.filter(F.col(label).isNotNull())
    row = df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n")).first()
    if not row["n"]:
        return Boosted([], list(cols), depth)
    weight = (row["n"] - row["pos"]) / max(row["pos"], 1)
    edges = edges or bin_edges(df, cols)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    width = len(cols)
    sides = [np.array(edges[c], dtype=float) for c in cols]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            bins = np.column_stack([np.searchsorted(s, x[:, i], side="left") for i, s in enumerate(sides)]).astype(np.int32)
            packed = pa.ListArray.from_arrays(pa.array(np.arange(0, bins.size + 1, width, dtype=np.int32)), pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([packed, *(batch.column(c) for c in ("y", "w", "margin", "k"))], names=["bins", "y", "w", "margin", "k"])

    schema = "bins array<int>, y double, w double, margin double, k bigint"
    rows = df.select(F.array(*[value(c) for c in cols]).alias("x"), F.col(label).cast("double").alias("y"),
                     F.when(F.col(label) == 1, float(weight)).otherwise(1.0).alias("w"), F.lit(0.0).alias("margin"),
                     F.xxhash64(*[F.col(c) for c in ([key] if key else cols)], F.lit(seed)).alias("k"))
    # every level of a tree is a job, so few rows go in few tasks
    tasks = max(1, row["n"] // TASK_ROWS)
    data = cut(rows.coalesce(tasks).mapInArrow(code, schema))
    rng = np.random.default_rng(seed)
    columns = [sorted(rng.choice(width, max(1, round(width * column_share)), replace=False).tolist()) for _ in range(rounds)]
    if tasks == 1:  # so few rows that one task holds them: it grows the trees one after the other, with no job for each level
        grown = data.mapInArrow(_grow_here(columns, sides, depth, step, row_share), _TREES).collect()
        return Boosted([{k: r[k] for k in ("feature", "bin", "cut", "value")} for r in sorted(grown, key=lambda r: r["tree"])], list(cols), depth)
    done, recent = [], []
    for round_, allowed in enumerate(columns):
        tree, nodes = _seedling(depth), [0]
        for _ in range(depth):
            sums = _sums(data, recent, tree, nodes, width, depth, round_, row_share)
            after = []
            for node, part in sums.groupby("node"):
                g, h = np.zeros((width, BINS)), np.zeros((width, BINS))
                g[part["col"], part["bin"]], h[part["col"], part["bin"]] = part["g"] / UNIT, part["h"] / UNIT
                after += _branch(tree, node, g, h, allowed, sides, step)
            nodes = sorted(after)
            if not nodes:
                break
        recent.append(tree)
        done.append(tree)
        if len(recent) == FROZEN_ROUNDS and round_ + 1 < rounds:
            data, recent = cut(data.mapInArrow(_freeze(recent, width, depth), schema)), []
    return Boosted(done, list(cols), depth)


_TREES = "tree int, feature array<int>, bin array<int>, cut array<double>, value array<double>"


def _seedling(depth: int) -> dict:
    size = 2 ** (depth + 1) - 1
    return {"feature": [-1] * size, "bin": [0] * size, "cut": [0.0] * size, "value": [0.0] * size}


def _branch(tree: dict, node: int, g: np.ndarray, h: np.ndarray, allowed: list[int], sides: list[np.ndarray], step: float) -> list[int]:
    """Value and best split of a node of the growing tree from its (columns x bins) sums; its children, if it has a split."""
    leaf = lambda gs, hs: float(-step * _soft(gs) / (hs + L2))
    tree["value"][node] = leaf(g[0].sum(), h[0].sum())
    found = _best(g, h, allowed)
    if not found:
        return []
    c, b = found
    tree["feature"][node], tree["bin"][node], tree["cut"][node] = c, b, float(sides[c][b])
    gl, hl = g[c, :b + 1].sum(), h[c, :b + 1].sum()
    tree["value"][2 * node + 1] = leaf(gl, hl)
    tree["value"][2 * node + 2] = leaf(g[c].sum() - gl, h[c].sum() - hl)
    return [2 * node + 1, 2 * node + 2]


def _grow_here(columns: list[list[int]], sides: list[np.ndarray], depth: int, step: float, row_share: float):
    """All rounds on the rows of one task, fewer than two times ``TASK_ROWS``: the same sums and splits as level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_columns(b, len(sides)) for b in batches if b.num_rows]
        bins, y, w, margin, key = (np.concatenate(p) for p in zip(*parts))
        for round_, allowed in enumerate(columns):
            tree, nodes = _seedling(depth), [0]
            g, h = _derivatives(y, w, margin)
            here = _drawn(key, round_, row_share)
            for _ in range(depth):
                total = _totals(bins, g, h, _places(bins, tree, depth), here, nodes) / UNIT
                met = [i for i in range(len(nodes)) if total[:, i].any()]
                nodes = [n for i in met for n in _branch(tree, nodes[i], total[0, i], total[1, i], allowed, sides, step)]
                if not nodes:
                    break
            margin = margin + np.array(tree["value"])[_places(bins, tree, depth)]
            yield pa.RecordBatch.from_pylist([{"tree": round_, **tree}], schema=_TREE_ROW)

    return run


_TREE_ROW = pa.schema([("tree", pa.int32()), ("feature", pa.list_(pa.int32())), ("bin", pa.list_(pa.int32())), ("cut", pa.list_(pa.float64())),
                       ("value", pa.list_(pa.float64()))])


def _freeze(trees: list[dict], width: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, _, margin, _ = _columns(batch, width)
            for t in trees:
                margin = margin + np.array(t["value"])[_places(bins, t, depth)]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return run


def probability(df: DataFrame, model: Boosted, cols: list[str]) -> DataFrame:
    """Add ``probability``; one pass, the model goes along."""
    sent = df.sparkSession.sparkContext.broadcast([(np.array(t["feature"]), np.array(t["cut"]), np.array(t["value"])) for t in model.trees])
    depth = model.depth

    @F.pandas_udf(T.DoubleType())
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float, na_value=np.nan) for s in series])
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cuts, value in sent.value:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + np.where(x[rows, np.maximum(f, 0)] <= cuts[node], 1, 2))
            margin += value[node]
        return pd.Series(1.0 / (1.0 + np.exp(-margin)))

    return df.withColumn("probability", score(*[F.col(c).cast("double") for c in cols]))


def held_out_f1(scored: DataFrame, label: str = "label", threshold: float = 0.5) -> float:
    """F1 of ``probability`` at the threshold; zero where nothing is found or nothing is there."""
    hit, said = F.col(label) == 1, F.col("probability") >= threshold
    row = scored.agg(F.count_if(hit & said).alias("tp"), F.count_if(hit).alias("pos"), F.count_if(said).alias("said")).first()
    return 2.0 * row["tp"] / (row["pos"] + row["said"]) if row["tp"] else 0.0
