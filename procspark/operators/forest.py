"""Isolation forest (Liu et al., 2008) and its path-dependent Shapley attributions (Lundberg et al., 2018).

Spark draws the samples, spreads the trees over tasks and scores the rows in Arrow batches; what runs inside a
task is one small tree at a time. The model size is fixed by its parameters (trees x 2 x sample rows), so it
can travel to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procspark.session import cut, spread

TREES, SAMPLE_ROWS = 300, 256
POOL_FACTOR = 2
PRIME = (1 << 31) - 1
_TREE = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("cut", T.ArrayType(T.DoubleType())), T.StructField("left", T.ArrayType(T.IntegerType())),
    T.StructField("right", T.ArrayType(T.IntegerType())), T.StructField("size", T.ArrayType(T.IntegerType())),
    T.StructField("depth", T.ArrayType(T.IntegerType())),
])


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def sample_rows(df: DataFrame, key: str, cols: list[str], trees: int, rows: int, seed: int) -> tuple[DataFrame, int]:
    """``tree, place, key, x``: for every tree the ``rows`` rows with its smallest numbers (all, if there are fewer), and the table's rows.

    Every row has two numbers from its key's digest and, from them, a number for every tree; a tree's rows are a random set
    of exactly that size, independent of the partitioning. Rows are thinned by a third number to about ``POOL_FACTOR`` times
    what all trees need, then by a bound on the trees' numbers, so a tree's candidates are few whatever the table. A tree
    left short (next to impossible) is drawn anew under a wider bound. Rows of equal keys are told apart by their values.
    """
    n = df.count()
    want = min(n, rows)
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    part = lambda at: F.conv(F.substring(digest, at, 10), 16, 10).cast("bigint")
    source = df.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), (part(1) % PRIME).alias("a"),
                       (part(11) % (PRIME - 1) + 1).alias("b"), part(21).alias("u"))
    share = min(1.0, POOL_FACTOR * trees * rows / max(n, 1))
    while True:
        pool = cut(source.filter(F.col("u") < F.lit(int(share * (1 << 40)))).drop("u"))
        size = pool.count()
        if size >= want:
            break
        share = min(1.0, 2 * share)
    bound = min(1.0, 2 * rows / max(size, 1))
    first = Window.partitionBy("tree").orderBy("number", "key", "x")
    while True:
        dealt = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        near = dealt.withColumn("number", (F.col("a") + F.col("tree") * F.col("b")) % PRIME).filter(F.col("number") < F.lit(int(bound * PRIME) + 1))
        drawn = cut(near.withColumn("place", F.row_number().over(first) - 1).filter(F.col("place") < want).select("tree", "place", "key", "x"))
        if bound >= 1 or drawn.count() == trees * want:
            return drawn, n
        bound = min(1.0, 2 * bound)


def draws(sample: int, n: int, slots: int, rng: np.random.Generator) -> np.ndarray:
    """Places of ``slots`` draws with replacement among ``n`` rows, of which a random ``sample`` is at hand in random order.

    A draw meets one of the ``d`` rows drawn before with probability ``d / n``, else it is the next one.
    """
    out, fresh = np.zeros(slots, dtype=int), 0
    for i, u in enumerate(rng.random(slots)):
        old = int(u * n)  # below ``fresh``: that one again
        out[i] = old if old < fresh else fresh
        fresh += old >= fresh
    assert fresh <= sample
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "size", "depth")}

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(out["size"])
        for k, v in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("size", len(rows)), ("depth", depth)):
            out[k].append(v)
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            c = float(rng.uniform(low[f], high[f]))
            c = low[f] if c >= high[f] else c
            goes = part[:, f] <= c
            out["feature"][at], out["cut"][at] = f, c
            out["left"][at] = add(rows[goes], depth + 1)
            out["right"][at] = add(rows[~goes], depth + 1)
        return at

    add(np.arange(len(x)), 0)
    return out


@dataclass
class Forest:
    """The trees as plain arrays, the sample size, the input columns, and the decision offset."""

    trees: list[dict]
    sample: int
    cols: list[str]
    offset: float = -0.5


def fit(df: DataFrame, key: str, cols: list[str], trees: int = TREES, rows: int = SAMPLE_ROWS, seed: int = 42) -> Forest:
    """Every tree grows on as many draws with replacement as its sample has rows."""
    drawn, n = sample_rows(df, key, cols, trees, rows, seed)
    sample = min(rows, n)
    limit = max(1, math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        number = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, number])
        tree = _grow(np.array(pdf["x"].tolist(), dtype=float)[draws(len(pdf), n, sample, rng)], rng, limit)
        return pd.DataFrame([{"tree": number, **tree}])

    # each group is one tree's sample of at most ``rows`` rows
    grown = drawn.groupBy("tree").applyInPandas(grow, _TREE)
    model = [r.asDict() for r in grown.collect()]
    return Forest(sorted(model, key=lambda r: r["tree"]), sample, list(cols))


def _arrays(forest: Forest) -> list[tuple]:
    out = []
    for t in forest.trees:
        size = np.array(t["size"])
        out.append((np.array(t["feature"]), np.array(t["cut"]), np.array(t["left"]), np.array(t["right"]), size,
                    np.array(t["depth"]) + average_path(size)))
    return out


def sample_score(df: DataFrame, forest: Forest, name: str = "sample_score") -> DataFrame:
    """Add the score in [-1, 0]: the closer to -1 the easier the row is isolated."""
    model = df.sparkSession.sparkContext.broadcast(_arrays(forest))
    norm, depth = float(average_path(forest.sample)), max(max(t["depth"]) for t in forest.trees)

    @F.pandas_udf(T.DoubleType())
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in series])
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, _, length in model.value:
            at = np.zeros(len(x), dtype=int)
            for _ in range(depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += length[at]
        return pd.Series(-np.power(2.0, -total / len(model.value) / norm))

    return df.withColumn(name, score(*[F.col(c) for c in forest.cols]))


def offset_for(scores: DataFrame, contamination: float, accuracy: int = 100_000) -> float:
    """The score below which the given share of the training rows lies (a mergeable sketch, not a sort)."""
    return scores.agg(F.percentile_approx("sample_score", contamination, accuracy)).first()[0]


def decision(forest_scores: DataFrame, offset: float) -> DataFrame:
    """Negative values are anomalies."""
    return forest_scores.withColumn("decision", F.col("sample_score") - F.lit(offset))


# ---------------------------------------------------------------------------------------------
# attributions


def _leaves(tree: tuple) -> list[tuple]:
    """Per leaf: its features, their interval, the share of training rows each condition keeps, its length."""
    feature, cut, left, right, size, length = tree
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        if feature[node] < 0:
            out.append((list(path), [path[f] for f in path], float(length[node])))
            continue
        f = int(feature[node])
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, bounds in ((left[node], (low, min(high, cut[node]))), (right[node], (max(low, cut[node]), high))):
            todo.append((child, {**path, f: (*bounds, share * size[child] / size[node])}))
    return out


def _shapley(share: np.ndarray) -> np.ndarray:
    """Shapley values of the games 'all conditions hold' of many leaves with ``m`` conditions each (``share``: leaves x m), where an absent condition holds
    with its share: leaves x conditions x hit patterns. Each coalition size weighs one coefficient of the product of the other conditions."""
    leaves, m = share.shape
    hit = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
    weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    out = np.zeros((leaves, m, 1 << m))
    for j in range(m):
        poly = np.ones((leaves, 1 << m, 1))
        for i in range(m):
            if i != j:
                wider = np.zeros((leaves, 1 << m, poly.shape[2] + 1))
                wider[:, :, :-1] = poly * share[:, i, None, None]
                wider[:, :, 1:] += poly * hit[:, i, None]
                poly = wider
        out[:, j] = (hit[:, j] - share[:, j, None]) * (poly @ weight)
    return out


_TABLE_CELLS = 1 << 14  # numbers of one step of the tables


def _tables(leaves: list[tuple]) -> list[np.ndarray]:
    """Per leaf its values for every hit pattern, times its length; leaves with equally many conditions are worked out together."""
    out, alike = [None] * len(leaves), {}
    for at, (feats, _, _) in enumerate(leaves):
        alike.setdefault(len(feats), []).append(at)
    for m, places in alike.items():
        step = max(1, _TABLE_CELLS // (max(m, 1) << m))
        for lo in range(0, len(places) if m else 0, step):
            part = places[lo:lo + step]
            for at, table in zip(part, _shapley(np.array([[share for _, _, share in leaves[at][1]] for at in part]))):
                out[at] = table
    return out


GROUP_BITS = 9  # outcomes from which the values of a group of leaves follow: two to that power for a feature and group
_CHUNK = 10_000  # rows that are explained at a time


def _paths(tree: tuple) -> list[list[tuple[int, int]]]:
    """Per leaf, in the order of ``_leaves``, the inner nodes above it and the side that is taken there (1: up to the cut)."""
    feature, _, left, right = tree[:4]
    out, todo = [], [(0, [])]
    while todo:
        node, path = todo.pop()
        if feature[node] < 0:
            out.append(path)
        else:
            todo += [(left[node], [*path, (node, 1)]), (right[node], [*path, (node, 0)])]
    return out


def _groups(tree: tuple, bits: int) -> list[tuple[int, int, int]]:
    """Leaves next to each other, ``from, to`` and how much of the path is theirs in common, so that few look-ups serve all leaves.

    A group's values follow from one outcome for each feature of the common path and one for each test below it, ``bits`` at most (a leaf alone may have
    more). Of all such partitions the one with the fewest look-ups, one for each group and feature, is found leaf by leaf.
    """
    paths, feature = _paths(tree), tree[0]
    cost, first = [0.0] + [math.inf] * len(paths), [(0, 0)] * (len(paths) + 1)
    for i, path in enumerate(paths):
        common, below, names = len(path), set(), {feature[n] for n, _ in path}
        for j in range(i, len(paths)):
            now = paths[j]
            same = next((k for k, (p, q) in enumerate(zip(path[:common], now)) if p != q), common)
            below |= {n for n, _ in path[same:common]} | {n for n, _ in now[same:]}
            common, names = same, names | {feature[n] for n, _ in now}
            size = len({feature[n] for n, _ in path[:common]}) + len(below)
            if j > i and size > bits:
                break
            found = cost[i] + len(names) + 0.3 * size + 1
            if found < cost[j + 1]:
                cost[j + 1], first[j + 1] = found, (i, common)
    out, end = [], len(paths)
    while end:
        start, common = first[end]
        out.append((start, end, common))
        end = start
    return out[::-1]


def _plan(tree: tuple, bits: int = GROUP_BITS) -> tuple[list, list]:
    """The tests of a tree, as ``feature, cut``, and its groups: for every outcome the one or two tests it is made of, the features, and for every leaf
    its number, its features and per feature the outcomes that must be 1 and that must be 0."""
    feature, cut = tree[0], tree[1]
    number = {n: i for i, n in enumerate(np.flatnonzero(feature >= 0).tolist())}
    paths, groups = _paths(tree), []
    for start, end, common in _groups(tree, bits):
        outcomes, above = [], {}
        low, high = {}, {}
        for n, side in paths[start][:common]:  # the last test of a side is the narrowest
            (high if side else low)[int(feature[n])] = number[n]
        for f in {**low, **high}:
            # a value below the lower cut is below the upper one: both outcomes differ where it lies between them
            above[f] = ([len(outcomes)], []) if f in high else ([], [len(outcomes)])
            outcomes.append(tuple(t[f] for t in (high, low) if f in t))
        places = {}
        for path in paths[start:end]:
            for n, _ in path[common:]:
                if n not in places:
                    places[n] = len(outcomes)
                    outcomes.append((number[n],))
        leaves = []
        for at in range(start, end):
            must = {f: (list(yes), list(no)) for f, (yes, no) in above.items()}
            for n, side in paths[at][common:]:
                must.setdefault(int(feature[n]), ([], []))[0 if side else 1].append(places[n])
            leaves.append((at, must))
        groups.append((outcomes, sorted({f for _, must in leaves for f in must}), leaves))
    return [(int(feature[n]), float(cut[n])) for n in number], groups


def _group_tables(leaves: list[tuple], groups: list, scale: float) -> list[np.ndarray]:
    """Per group its features' values for all outcomes: the sums over its leaves of their values for the hit patterns that follow from the outcomes."""
    tables, out = _tables(leaves), []
    for outcomes, feats, members in groups:
        code = np.arange(1 << len(outcomes))
        is_set = [(code >> b & 1).astype(bool) for b in range(len(outcomes))]
        total = np.zeros((len(feats), len(code)))
        for at, must in members:
            names, _, length = leaves[at]
            pattern = np.zeros(len(code), dtype=np.intp)
            for bit, f in enumerate(names):
                yes, no = must[f]
                hit = np.ones(len(code), dtype=bool)
                for b in yes:
                    hit &= is_set[b]
                for b in no:
                    hit &= ~is_set[b]
                pattern |= hit.astype(np.intp) << bit
            for f, values in zip(names, tables[at] if names else ()):
                total[feats.index(f)] -= (length * scale * values)[pattern]
        out.append(total)
    return out


def _explained(columns: np.ndarray, plans: list[tuple], tables_of: list[list[np.ndarray]]) -> np.ndarray:
    """Features x rows: the impacts of all trees. ``columns``: features x rows; a missing number lies above all cuts, as where it is scored."""
    total = np.zeros(columns.shape)
    for lo in range(0, columns.shape[1], _CHUNK):
        x, sums = columns[:, lo:lo + _CHUNK], total[:, lo:lo + _CHUNK]
        n = x.shape[1]
        code, place, values = np.empty(n, np.uint16), np.empty(n, np.intp), np.empty(n)
        for (tests, groups), tables in zip(plans, tables_of):
            below = np.empty((len(tests), n), np.uint16)
            for i, (f, c) in enumerate(tests):
                below[i] = x[f] <= c
            for (outcomes, feats, _), table in zip(groups, tables):
                code[:] = 0
                for made_of in reversed(outcomes):
                    code += code
                    code += below[made_of[0]] if len(made_of) == 1 else below[made_of[0]] ^ below[made_of[1]]
                place[:] = code
                for f, row in zip(feats, table):
                    sums[f] += np.take(row, place, out=values, mode="clip")
    return total


def attributions(df: DataFrame, forest: Forest, raw: list[str] | None = None, key: str = "tx_id") -> DataFrame:
    """``key, expected, attributions``: per feature the impact on minus the mean path length, largest first.

    Positive impacts push towards "anomalous". The impacts of a row add up to its own value minus the expected
    one. Every row is explained; a group of leaves costs one look-up per row and feature in its table of outcomes, which a worker makes once.
    """
    n, names = len(forest.trees), forest.cols
    arrays = _arrays(forest)
    model = df.sparkSession.sparkContext.broadcast(([_leaves(t) for t in arrays], [_plan(t) for t in arrays], []))
    item = "array<struct<feature: string, raw_value: double, impact: double>>"
    key_type = df.schema[key].dataType.simpleString()

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, plans, tables_of = model.value
        if not tables_of:  # made once in a worker, which keeps them for its later tasks
            tables_of.extend(_group_tables(leaves, groups, 1 / n) for leaves, (_, groups) in zip(trees, plans))
        base = -sum(length * float(np.prod([b[2] for b in bounds])) for leaves in trees for _, bounds, length in leaves) / n
        for batch in batches:
            x, shown = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                        for c in ("x", "shown" if raw else "x"))
            phi = np.ascontiguousarray(_explained(np.ascontiguousarray(x.T), plans, tables_of).T)
            order = np.argsort(-np.abs(phi), axis=1, kind="stable")
            items = pa.StructArray.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(order.ravel())), pa.array(np.take_along_axis(shown, order, axis=1).ravel()),
                 pa.array(np.take_along_axis(phi, order, axis=1).ravel())], names=["feature", "raw_value", "impact"])
            ends = pa.array(np.arange(0, order.size + 1, len(names), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.full(len(x), base)), pa.ListArray.from_arrays(ends, items)],
                                             names=[key, "expected", "attributions"])

    vec = lambda cols: F.array(*[F.col(c).cast("double") for c in cols])
    rows = df.select(key, vec(forest.cols).alias("x"), *([vec(raw).alias("shown")] if raw else []))
    # the work per row is heavy, so rows that come in few tasks are dealt to all; large tables stay where they are
    return spread(rows).mapInArrow(explain, f"{key} {key_type}, expected double, attributions {item}")
