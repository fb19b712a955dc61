"""Betweenness by multi-source search: the state of a node is one row per block of sources, whatever their number.

Sources are dealt into blocks of ``SOURCES``. A row ``(t, block, paths)`` of a level holds, as one packed vector, the number of shortest paths to ``t``
from every source of the block that reaches it at this level; ``seen`` is a bit per source. One level sends each such row along the edges of
its node, adds up what meets at a node and takes away the sources that came before. Vectors are added in the sending task first, so a level
shuffles one vector per node, block and task, and no row per pair of nodes ever exists. Dependencies go back the same way.

Every node is a source by default. With a ``share`` below one, sources are drawn by a hash of the node; ``error_bound`` says how far
off a node's value may be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procspark.operators import packed
from procspark.session import cut

SOURCES = 256


def error_bound(sources: int, risk: float = 0.05) -> float:
    """How far the normalized betweenness of a node may be off with a chance of at most ``risk``: each source adds a value from 0 to 1, so
    Hoeffding's bound holds for the mean over ``sources`` of them."""
    return math.sqrt(math.log(2 / risk) / (2 * max(sources, 1)))


def drawn(node: Column, share: float) -> Column:
    """Whether a node is a source: by a hash, so a run that is repeated draws the same."""
    return (F.pmod(F.xxhash64(node), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))) if share < 1 else F.lit(True)


def class_betweenness(adj: DataFrame, heads: DataFrame, k: int = SOURCES) -> DataFrame:
    """``t, total``: the dependencies on one member of class ``t``, summed over the sources.

    ``adj`` (``a, b``) are the links between classes of nodes with equal neighbours, in both directions. ``heads`` (``c, size, clique, weight``)
    tells how many nodes a class has, whether they are neighbours of each other, and how many of them are sources.
    """
    size = heads.select(F.col("c").alias("t"), F.col("size").cast("double").alias("many"))
    start = cut(packed.dealt(heads.filter("weight > 0"), k))

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        vec = np.zeros((batch.num_rows, k))
        vec[np.arange(batch.num_rows), batch.column(2).to_numpy()] = 1.0
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed.binary(vec > 0), packed.binary(vec)], names=["t", "block", "seen", "vec"])

    state_schema = "t string, block int, seen binary, vec binary"
    state = cut(start.select("c", "block", "place").mapInArrow(lambda bs: map(first, bs), state_schema))
    levels = [state.select("t", "block", "vec", F.lit(1.0).alias("many"))]

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, zero = bytes(k), bytes(8 * k)
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = packed.matrix(pa.array([s or none for s in batch.column(2).to_pylist()], pa.binary()), np.bool_, k)
            vec = np.where(seen, 0.0, packed.matrix(pa.array([v or zero for v in batch.column(3).to_pylist()], pa.binary()), np.float64, k))
            new = vec.any(axis=1)
            rows = [row.tobytes() if n else None for row, n in zip(vec, new)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed.binary(seen | (vec > 0)), pa.array(rows, pa.binary())], names=["t", "block", "seen", "vec"])

    while True:
        sent = levels[-1].join(adj, F.col("t") == F.col("a")).select(F.col("b").alias("t"), "block", "vec", F.col("many").alias("times"))
        met = packed.added(sent, k)
        state = cut(state.select("t", "block", "seen").join(met, ["t", "block"], "full").select("t", "block", "seen", "vec").mapInArrow(fresh, state_schema))
        level = state.filter("vec is not null").select("t", "block", "vec").join(size, "t")
        if level.isEmpty():
            break
        levels.append(level)

    # members of an open source class reach each other through every neighbour of theirs
    degree = adj.join(size.withColumnRenamed("t", "b"), "b").groupBy("a").agg(F.sum("many").alias("degree"))
    own = F.when(~F.col("clique") & (F.col("size") > 1), (F.col("size") - 1) / F.col("degree")).otherwise(0.0)
    places = start.join(degree, start.c == degree.a, "left").groupBy("block").agg(
        F.collect_list(F.struct("place", F.col("weight").cast("double").alias("weight"), F.coalesce(own, F.lit(0.0)).alias("own"))).alias("places"))
    places = cut(places)  # at most k entries a row

    def by_place(cells: list[dict], name: str) -> np.ndarray:
        out = np.zeros(k)
        for c in cells:
            out[c["place"]] = c[name]
        return out

    total = None
    below = None  # t, block, vec = (1 + delta) / paths of the level below
    for depth in range(len(levels) - 1, 0, -1):
        last = depth == 1

        def back(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            zero = bytes(8 * k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                paths = packed.matrix(batch.column(2), np.float64, k)
                share = packed.matrix(pa.array([v or zero for v in batch.column(3).to_pylist()], pa.binary()), np.float64, k)
                cells = batch.column(4).to_pylist()
                delta = paths * share
                if last:
                    delta += np.where(paths > 0, np.array([by_place(c, "own") for c in cells]), 0.0)
                told = (delta * np.array([by_place(c, "weight") for c in cells])).sum(axis=1)
                up = np.where(paths > 0, (1.0 + delta) / np.where(paths > 0, paths, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed.binary(up), pa.array(told)], names=["t", "block", "vec", "total"])

        here = levels[depth]
        if below is None:
            rows = here.withColumn("share", F.lit(None).cast("binary"))
        else:
            sent = below.join(adj, F.col("t") == F.col("b")).select(F.col("a").alias("t"), "block", "vec", F.col("many").alias("times"))
            rows = here.join(packed.added(sent, k).select("t", "block", F.col("vec").alias("share")), ["t", "block"], "left")
        rows = rows.join(places, "block").select("t", "block", "vec", "share", "places")
        found = cut(rows.mapInArrow(back, "t string, block int, vec binary, total double"))
        below = found.select("t", "block", "vec").join(size, "t")
        part = found.groupBy("t").agg(F.sum("total").alias("total"))
        total = part if total is None else total.unionByName(part)
    if total is None:
        return size.select("t", F.lit(0.0).alias("total")).limit(0)
    return total.groupBy("t").agg(F.sum("total").alias("total"))
