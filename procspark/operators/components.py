"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procspark.session import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``src, dst`` -> ``node, component``; a component is named by its smallest node.

    Rounds go on until none changes an edge; their number grows with the logarithm of the longest path. Every round is frozen in the shared folder. A hub only ever meets one-row-per-node minima, so its join is
    split by the run-time skew handling and nothing is collected per node.
    """
    self_loops = edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))
    now = cut(edges.filter(F.col("src") != F.col("dst")).select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
    mark = _mark(now)
    while True:
        now = cut(_small_star(_large_star(now)))
        new = _mark(now)
        if new == mark:
            break
        mark = new
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).unionByName(self_loops).distinct()
    roots = roots.join(member.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return member.unionByName(roots)
