"""A Merkle manifest of a dataset that persists only every few levels.

The leaves of a source, in order, are the lowest level of its tree; every ``FAN`` consecutive nodes become the digest of their
joined digests until one is left. The roots of the sources, in order, are the leaves of one more tree. Of all levels only
every ``EVERY``-th is stored: as blocks of up to ``FAN ** EVERY`` consecutive nodes, which are the lowest nodes of one aligned
subtree. The levels between are computed where they are needed, and forgotten: once for the top of each block, which is a node of the next
stored level, and again when proofs are taken, where a block with its regenerated levels gives the siblings of every member.

A node's place comes from its rank in a range-partitioned order, so a source with a third of all rows is spread over many tasks; blocks
are keys of bounded size. Proofs go down from the top, one join per stored level, and a block meets one row of its parent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procspark.session import cut, shuffle_width

FAN, EVERY = 3, 3
_ROW = (1 << 33) - 1  # monotonically_increasing_id: the partition above, the row in it below
_SENT_ROWS, _SENT_BYTES = 100_000, 8 << 20


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(name: str) -> Column:
    """A value with its length in front, so that no two rows of values read alike; ``-`` for null."""
    text = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(df: DataFrame, order: list[Column], name: str = "at") -> DataFrame:
    """``df`` with the place of each row in the whole order, from 0; written in that order to the shared folder."""
    width = shuffle_width(df.sparkSession)
    held = cut(df.repartitionByRange(width, *order).sortWithinPartitions(*order)).withColumn("mark*", F.monotonically_increasing_id())
    part = F.shiftright("mark*", 33).alias("part*")
    sizes = sorted(map(tuple, held.groupBy(part).agg(F.count("*")).collect()))  # one row for each partition
    first, starts = 0, []
    for number, n in sizes:
        starts.append((number, first))
        first += n
    before = df.sparkSession.createDataFrame(starts, "`part*` bigint, `start*` bigint")
    return held.withColumn("part*", part).join(F.broadcast(before), "part*").withColumn(
        name, F.col("`start*`") + F.col("`mark*`").bitwiseAND(F.lit(_ROW))).drop("mark*", "part*", "start*")


def _sent(df: DataFrame, text: str) -> DataFrame:
    """A side table, broadcast only if it was counted and measured and found small."""
    held = cut(df)
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return F.broadcast(held) if n <= _SENT_ROWS and size <= _SENT_BYTES else held


def _steps(n: str = "n") -> Column:
    """How many levels a block of a level with ``n`` nodes still has above it, up to ``EVERY``."""
    return F.size(F.filter(F.array(*[F.lit(FAN ** i) for i in range(EVERY)]), lambda x: x < F.col(n)))


def _above(level: str) -> Column:
    """The digests one level up."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * FAN + 1, FAN), "")))


def _opened(blocks: DataFrame) -> DataFrame:
    """Blocks with their regenerated levels ``l0 .. lEVERY``; levels above the root of a tree are null."""
    out = blocks.withColumn("steps", _steps()).withColumn("l0", F.transform("members", lambda m: m["digest"]))
    for k in range(1, EVERY + 1):
        out = out.withColumn(f"l{k}", F.when(F.col("steps") >= k, _above(f"l{k - 1}")))
    return out


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """``tree, block, n, members``: consecutive nodes of a tree, at most ``FAN ** EVERY`` of them, in order."""
    return nodes.groupBy("tree", F.floor(F.col("at") / FAN ** EVERY).cast("bigint").alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", *carried))).alias("members"))


@dataclass
class Forest:
    """The stored levels of trees over the same kind of leaves, lowest first."""

    levels: list[DataFrame]
    carried: list[str]

    def roots(self) -> DataFrame:
        """``tree, digest``: a tree ends at the level where it has one node."""
        ends = [b.filter("n = 1").select("tree", F.col("members")[0]["digest"].alias("digest")) for b in self.levels]
        out = ends[0]
        for e in ends[1:]:
            out = out.unionByName(e)
        return out

    def proofs(self, apex: DataFrame | None = None) -> DataFrame:
        """``tree, at, digest, <carried>, proof``: the siblings of every leaf as ``(l, r)`` per level, what stands left and right of
        the path. ``apex`` (``tree, proof``) is what follows beyond each root."""
        up = None
        for level, blocks in reversed(list(enumerate(self.levels))):
            carried = self.carried if level == 0 else []
            parents = None
            if apex is not None:
                parents = blocks.filter("n = 1").select("tree").join(apex, "tree").select("tree", F.lit(0).cast("bigint").alias("block"), "proof")
            if up is not None:
                higher = up.select("tree", F.col("at").alias("block"), "proof")
                parents = higher if parents is None else higher.unionByName(parents)
            empty = F.array().cast("array<struct<l:string,r:string>>")
            if parents is not None:
                blocks = blocks.join(parents, ["tree", "block"], "left").withColumn("proof", F.coalesce("proof", empty))
            else:
                blocks = blocks.withColumn("proof", empty)
            rows = _opened(blocks).select("tree", "proof", "steps", *[f"l{k}" for k in range(EVERY)], F.posexplode("members").alias("i", "m"))
            mine = []
            for k in range(EVERY):
                own = F.floor(F.col("i") / FAN ** k).cast("int")
                turn = F.pmod(own, F.lit(FAN))
                side = lambda first, n: F.array_join(F.slice(f"l{k}", first, n), "")  # noqa: E731, B023
                mine.append(F.struct(side(own - turn + 1, turn).alias("l"), side(own + 2, FAN - 1 - turn).alias("r")))
            up = rows.select("tree", F.col("m")["at"].alias("at"), F.col("m")["digest"].alias("digest"), *[F.col("m")[c].alias(c) for c in carried],
                             F.concat(F.slice(F.array(*mine), F.lit(1), F.col("steps")), "proof").alias("proof"))
        return up


def grow(nodes: DataFrame, carried: list[str] = ()) -> Forest:
    """The stored levels over leaves ``tree, at, n, digest`` (``n`` leaves in the tree, ``at`` from 0); each is frozen in the shared folder."""
    levels = [cut(_blocks(nodes, list(carried)))]
    while not levels[-1].filter("n > 1").isEmpty():
        opened = _opened(levels[-1].filter("n > 1"))
        tops = F.coalesce(*[F.col(f"l{k}") for k in range(EVERY, -1, -1)])
        up = opened.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / F.pow(F.lit(FAN), F.col("steps"))).cast("bigint").alias("n"), tops[0].alias("digest"))
        levels.append(cut(_blocks(up, [])))
    return Forest(levels, list(carried))


@dataclass
class Manifest:
    leaves: Forest  # a tree for each source
    sources: Forest  # one tree over their roots
    names: DataFrame  # tree, source, n, subroot
    root: str | None


def build(leaves: DataFrame, source: str = "source", order: tuple[str, ...] = ("doc_id",), carried: tuple[str, ...] = ()) -> Manifest:
    """The manifest of rows with their ``digest``.

    Sources are ordered by their bytes, null first; leaves of a source by ``order``, null first, then by digest, so rows with equal keys have
    a defined order and equal rows are leaves of their own. No rows: no root. ``carried`` columns go with the leaves into the proofs.
    """
    keep = list(dict.fromkeys((*order, *carried)))
    rows = cut(leaves.select(source, "digest", *keep))
    keys = [F.col(c).asc_nulls_first() for c in (source, *order, "digest")]
    rows = ranked(rows, keys, "row*")
    spans = rows.groupBy(source).agg(F.min("row*").alias("first*"), F.count("*").alias("n"))
    spans = _sent(ranked(spans, [F.col("first*").asc()], "tree"), source)
    placed = rows.alias("r").join(spans.alias("s"), F.col(f"r.{source}").eqNullSafe(F.col(f"s.{source}"))).select(
        "tree", (F.col("row*") - F.col("first*")).alias("at"), "n", "digest", *[F.col(f"r.{c}").alias(c) for c in keep])
    forest = grow(placed, keep)
    roots = cut(forest.roots())
    names = spans.join(roots, "tree").select("tree", source, "n", F.col("digest").alias("subroot"))
    count = F.lit(roots.count())
    top = grow(roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), count.alias("n"), "digest"))
    root = top.roots().first()
    return Manifest(forest, top, names, root.digest if root else None)


def proofs(made: Manifest) -> DataFrame:
    """``digest, <order and carried>, subroot, root, proof`` of every leaf."""
    at = cut(made.sources.proofs().select(F.col("at").alias("tree"), F.col("digest").alias("subroot"), "proof"))
    rows = made.leaves.proofs(at.select("tree", "proof"))
    named = _sent(at.select("tree", "subroot"), "subroot")
    return rows.join(named, "tree").select("digest", *made.leaves.carried, "subroot", F.lit(made.root).cast("string").alias("root"), "proof")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda now, p: digest(p["l"], now, p["r"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["l"], p["r"])), "")
