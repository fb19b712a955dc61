"""Vendor-agency and vendor-buyer-category graphs as edge tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procspark.operators import centrality, packed
from procspark.operators.components import connected_components
from procspark.operators.pairs import pair_tiles
from procspark.session import cut, shuffle_width


def agency_name() -> Column:
    return F.coalesce(F.nullif(F.col("agency"), F.lit("")), F.lit("UNKNOWN"))


def bipartite_edges(df: DataFrame) -> DataFrame:
    return df.groupBy("vendor_id", agency_name().alias("agency")).agg(F.count("*").alias("weight"))


def _number(df: DataFrame, value: Column, default: float) -> float:
    """One aggregate value; everything else stays distributed."""
    found = df.agg(value).first()[0]
    return default if found is None else found


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Share of the other nodes a vendor is linked to, and the score of it."""
    n = _number(edges, F.count_distinct("vendor_id") + F.count_distinct("agency"), 0)
    share = F.col("degree") / F.lit(float(max(n - 1, 1)))
    return edges.groupBy("vendor_id").agg(F.count("*").alias("degree")).select(
        "vendor_id", share.alias("centrality"), F.least(share * 2.0, F.lit(1.0)).alias("degree_score"))


def component_size(edges: DataFrame) -> DataFrame:
    """Vendors in the component of each vendor, relative to the largest component."""
    edges = cut(edges)  # read by the rounds and for the ids
    links = edges.select(F.concat(F.lit("v:"), "vendor_id").alias("src"), F.concat(F.lit("a:"), "agency").alias("dst"))
    comp = connected_components(links).filter(F.col("node").startswith("v:"))
    sizes = cut(comp.groupBy("component").agg(F.count("*").alias("vendors")))
    top = _number(sizes, F.max("vendors"), 1)
    ids = edges.select("vendor_id").distinct().withColumn("node", F.concat(F.lit("v:"), "vendor_id"))
    return ids.join(comp, "node").join(sizes, "component").select(
        "vendor_id", "vendors", (F.col("vendors") / F.lit(float(top))).alias("cluster_score"))


def neighbour_classes(edges: DataFrame, node: str, neighbour: str) -> DataFrame:
    """Nodes with the same set of neighbours, as ``node, class, size``; a class is named by its smallest node.

    Sets are told apart by their size and two independent 64-bit hashes, added up per node, so no neighbour
    list is ever collected.
    """
    pair = edges.select(node, neighbour).distinct()
    prints = pair.groupBy(node).agg(
        F.count("*").alias("k"), F.bit_xor(F.xxhash64(neighbour)).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("salt"), F.reverse(F.col(neighbour).cast("string")))).alias("h2"))
    classes = prints.groupBy("k", "h1", "h2").agg(F.min(node).alias("class"), F.count("*").alias("size"))
    return prints.join(classes, ["k", "h1", "h2"]).select(node, "class", "size", F.col("k").alias("degree"))


def bipartite_clustering(edges: DataFrame, places: int = 16_384) -> DataFrame:
    """Mean Jaccard overlap of a vendor's agencies with those of all vendors it shares one with.

    Vendors with equal agency sets are one class with a count. Classes are dealt into tiles of at most ``places`` (up to 2^16) and about ``TILE_LINKS``
    links; a tile's links are packed, agency by agency, and every two tiles meet in one task, which counts the common agencies of their classes and
    hands on one sum for each class. No row per pair of classes exists, and a link is sent as often as there are tiles. Agencies are told apart by
    64-bit hashes.
    """
    edges = cut(edges.select("vendor_id", "agency"))  # read for the classes' prints and for their links
    classes = cut(neighbour_classes(edges, "vendor_id", "agency"))
    heads = classes.filter(F.col("vendor_id") == F.col("class")).select(F.col("class").alias("c"), "size", "degree")
    n, n_links = heads.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0))).first()
    width = shuffle_width(edges.sparkSession)
    # every pair of tiles is one piece of work, of which a task should have a few
    places = max(1, min(places, -(-n // math.isqrt(8 * width)), TILE_LINKS * max(n, 1) // max(n_links, 1)))
    placed = cut(packed.dealt(heads, places))
    links = edges.select(F.col("vendor_id").alias("c"), "agency").distinct().join(placed, "c").select(
        "block", "place", F.lit(1).alias("kind"), F.xxhash64("agency").alias("what"))
    rows = placed.select("block", "place", F.lit(0).alias("kind"), F.col("size").alias("what")).unionByName(links)
    order = ["block", "kind", "what"]
    tiles = rows.repartition(width, "block").sortWithinPartitions(*order).mapInArrow(_pack, _PACKED)
    other = F.broadcast(placed.select(F.col("block").alias("other")).distinct())  # a number for each tile
    met = tiles.crossJoin(other).select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                                        (F.col("block") > F.col("other")).cast("int").alias("side"), "kind", "what", "times", "place")
    k = _number(placed, F.count_distinct("block"), 0)
    met = met.repartition(max(width, min(k * (k + 1) // 8, 4096)), "p", "q").sortWithinPartitions("p", "q", "side", "kind")
    sums = met.mapInArrow(lambda batches: _overlaps(batches, places), "t bigint, s double, n double").groupBy("t").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    twins = F.col("size") - 1
    total = F.coalesce("n", F.lit(0.0)) + twins
    value = F.when(total > 0, (F.coalesce("s", F.lit(0.0)) + twins) / total).otherwise(0.0)
    per_class = placed.withColumn("t", F.col("block").cast("bigint") * places + F.col("place")).join(sums, "t", "left").select(
        F.col("c").alias("class"), value.alias("clustering"))
    return classes.join(per_class, "class").select("vendor_id", "clustering")


TILE_LINKS = 2_000_000  # links of a tile on average
_PACKED = "block int, kind int, what binary, times binary, place binary"
_CELLS, _SHARES = 1 << 21, 1 << 17  # pairs of classes that are counted and divided at a time
_DENSE = 1024  # agencies of one matrix product
_MADE = 1 << 22  # common links that are listed at a time


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``block, place, kind, what`` in order, as one row for a batch's rows of a tile and kind: each ``what``, its rows and their places."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, place, kind, what = (batch.column(i).to_numpy() for i in range(4))
        starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])]))
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            heads = lo + np.flatnonzero(np.concatenate([[True], what[lo + 1:hi] != what[lo:hi - 1]]))
            out.append((int(block[lo]), int(kind[lo]), what[heads].tobytes(), np.diff(np.append(heads, hi)).astype(np.int32).tobytes(),
                        place[lo:hi].astype(np.uint16).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["block", "kind", "what", "times", "place"])


class _Tile:
    """The classes of a tile: sizes and degrees by place, and the places that have each agency, agencies in order."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]]):
        sizes, what, place = [], [], []
        for kind, values, times, at in rows:
            values = np.repeat(np.frombuffer(values, np.int64), np.frombuffer(times, np.int32))
            at = np.frombuffer(at, np.uint16).astype(np.int64)
            if kind:
                what.append(values)
                place.append(at)
            else:
                sizes.append((at, values))
        what, place = np.concatenate(what), np.concatenate(place)
        self.place = place[np.argsort(what, kind="stable")]
        self.agency, self.times = np.unique(what, return_counts=True)
        self.first = np.cumsum(self.times) - self.times
        self.degree = np.bincount(place).astype(float)
        self.size = np.zeros(len(self.degree))
        for at, values in sizes:
            self.size[at] = values

    def links(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number among the ``kept`` agencies of every link to one of them, by place."""
        number = np.full(len(self.agency), -1)
        number[kept] = np.arange(len(kept))
        of_link = np.repeat(number, self.times)
        place, of_link = self.place[of_link >= 0], of_link[of_link >= 0]
        order = np.argsort(place, kind="stable")
        return place[order], of_link[order]


def _listed(rows: np.ndarray, agency: np.ndarray, right: _Tile, kept: np.ndarray, cells: tuple[int, int]) -> np.ndarray:
    """Common agencies of left rows and right places, by listing the places of every left link's agency."""
    times, first = right.times[kept][agency], right.first[kept][agency]
    ends = np.cumsum(times)
    common, lo = np.zeros(cells[0] * cells[1], np.int64), 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _MADE, side="right")))
        t = times[lo:hi]
        at = np.repeat(first[lo:hi] - (np.cumsum(t) - t), t) + np.arange(t.sum())
        common += np.bincount(np.repeat(rows[lo:hi] * cells[1], t) + right.place[at], minlength=len(common))
        lo = hi
    return common.reshape(cells)


def _multiplied(rows: np.ndarray, agency: np.ndarray, place: np.ndarray, of_link: np.ndarray, n: int, cells: tuple[int, int], held: dict) -> np.ndarray:
    """The same as products of 0/1 matrices, some agencies at a time; the right one is ``held`` if it is the only one. Counts are exact up to 2^24."""
    common = None
    for lo in range(0, n, _DENSE):
        many = min(_DENSE, n - lo)
        if lo not in held:
            held.clear()
            held[lo] = np.zeros((many, cells[1]), np.float32)
            here = (of_link >= lo) & (of_link < lo + many)
            held[lo][of_link[here] - lo, place[here]] = 1
        left = np.zeros((cells[0], many), np.float32)
        here = (agency >= lo) & (agency < lo + many)
        left[rows[here], agency[here] - lo] = 1
        product = left @ held[lo]
        common = product if common is None else np.add(common, product, out=common)
    return common


def _meet(left: _Tile, right: _Tile, same: bool) -> tuple[np.ndarray, ...]:
    """Sums of overlaps and how many overlap: for the left places, then for the right ones (not of use if both are the ``same``)."""
    s, n = np.zeros(len(left.size)), np.zeros(len(left.size))
    back_s, back_n = np.zeros(len(right.size)), np.zeros(len(right.size))
    _, mine, theirs = np.intersect1d(left.agency, right.agency, assume_unique=True, return_indices=True)
    place, agency = left.links(mine)
    r_place, r_agency = right.links(theirs)
    wide, held = len(right.size), {}
    step = max(1, _CELLS // wide)
    for lo in range(0, len(left.size), step):
        hi = min(lo + step, len(left.size))
        a, b = np.searchsorted(place, [lo, hi])
        if a == b:
            continue
        rows, of_link, cells = place[a:b] - lo, agency[a:b], (hi - lo, wide)
        # a listed link costs about as much as 500 steps of a matrix product
        if 500 * int(right.times[theirs][of_link].sum()) < (hi - lo) * wide * len(mine):
            common = _listed(rows, of_link, right, theirs, cells)
        else:
            common = _multiplied(rows, of_link, r_place, r_agency, len(mine), cells, held)
        if same:
            common[np.arange(hi - lo), np.arange(lo, hi)] = 0
        few = max(1, _SHARES // wide)
        for at in range(lo, hi, few):
            part = slice(at, min(at + few, hi))
            c = common[at - lo:part.stop - lo].astype(float)
            has = (c > 0).astype(float)
            c /= left.degree[part, None] + right.degree - c
            s[part], n[part] = c @ right.size, has @ right.size
            if not same:
                back_s += left.size[part] @ c
                back_n += left.size[part] @ has
    return s, n, back_s, back_n


def _overlaps(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[pa.RecordBatch]:
    """Rows ``p, q, side, kind, what, times, place`` in order, those of two tiles after each other: for every class ``t`` of either tile the sum of its
    overlaps with the other's classes, and how many overlap."""

    def told(pair: tuple[int, int], sides: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        p, q = pair
        left = _Tile(sides[0])
        s, n, back_s, back_n = _meet(left, left if p == q else _Tile(sides[1]), p == q)
        for block, a, b in ((p, s, n), (q, back_s, back_n))[:1 if p == q else 2]:
            yield pa.RecordBatch.from_arrays([pa.array(block * places + np.arange(len(a))), pa.array(a), pa.array(b)], names=["t", "s", "n"])

    now, sides = None, ([], [])
    for batch in batches:
        for p, q, side, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if (p, q) != now:
                if now is not None:
                    yield from told(now, sides)
                now, sides = (p, q), ([], [])
            sides[side].append(row)
    if now is not None:
        yield from told(now, sides)


def co_occurrence(df: DataFrame) -> DataFrame:
    """How often a vendor bills the agency in a week together with others, counted without forming pairs."""
    seen = df.filter(F.col("agency").isNotNull() & F.col("ts").isNotNull()).select(
        "vendor_id", "agency", F.date_trunc("week", "ts").alias("week")).distinct()
    sizes = seen.groupBy("agency", "week").agg((F.count("*") - 1).alias("others")).filter(F.col("others") > 0)
    counts = cut(seen.join(sizes, ["agency", "week"]).groupBy("vendor_id").agg(F.sum("others").alias("co_count")))
    top = _number(counts, F.max("co_count"), 1)
    return counts.select("vendor_id", "co_count", (F.col("co_count") / F.lit(float(top))).alias("co_score"))


def concentration(edges: DataFrame) -> DataFrame:
    per = cut(edges.groupBy("vendor_id").agg((F.sum("weight") / F.count("*")).alias("concentration")))
    top = max(1.0, _number(per, F.max("concentration"), 1.0))
    return per.select("vendor_id", "concentration", (F.col("concentration") / F.lit(top)).alias("conc_score"))


def graph_risk_score(df: DataFrame) -> DataFrame:
    edges = cut(bipartite_edges(df))
    parts = [
        edges.select("vendor_id").distinct(),
        concentration(edges).select("vendor_id", "conc_score"),
        component_size(edges).select("vendor_id", "cluster_score"),
        degree_centrality(edges).select("vendor_id", "degree_score"),
        bipartite_clustering(edges),
        co_occurrence(df).select("vendor_id", "co_score"),
    ]
    rows = reduce(lambda a, b: a.join(b, "vendor_id", "left"), parts)
    part = lambda c: F.coalesce(c, F.lit(0.0))
    risk = (part("conc_score") * 0.30 + part("cluster_score") * 0.20 + part("degree_score") * 0.15
            + part("clustering") * 0.20 + part("co_score") * 0.15)
    return rows.select("vendor_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)), 4).alias("graph_risk_score"))


def graph_summary(scores: DataFrame) -> DataFrame:
    s = F.col("graph_risk_score")
    return scores.agg(F.count("*").alias("n_vendors"), F.round(F.coalesce(F.avg(s), F.lit(0.0)), 4).alias("mean_risk"),
                      F.round(F.coalesce(F.max(s), F.lit(0.0)), 4).alias("max_risk"),
                      F.coalesce(F.sum(F.when(s > 0.6, 1).otherwise(0)), F.lit(0)).alias("high_risk"))


# ---------------------------------------------------------------------------------------------
# vendor-buyer-category graph

# Limits of the three signals.
REPEAT_MIN, REPEAT_FULL = 5, 20.0
CLUSTER_NODES, CLUSTER_VENDORS, CLUSTER_BUYERS, CLUSTER_FULL = 12, 4, 2, 25.0
BRIDGE_MIN, BRIDGE_FACTOR = 0.18, 2.5


def _node(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.coalesce(F.col(kind), F.lit(f"unknown_{kind}")))


def award_edges(df: DataFrame) -> DataFrame:
    """Vendor-buyer and buyer-category edges weighted by records (columns vendor, buyer, category).

    Both come from one count per (vendor, buyer, category), so the records are shuffled once.
    """
    counts = df.groupBy("vendor", "buyer", "category").agg(F.count("*").alias("n"))
    one = lambda a, b, name: counts.groupBy(_node(a).alias("src"), _node(b).alias("dst")).agg(
        F.sum("n").alias("weight")).withColumn("relation", F.lit(name))
    return one("vendor", "buyer", "vendor_buyer").unionByName(one("buyer", "category", "buyer_category"))


def shared_buyer_classes(edges: DataFrame, block_rows: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """The shared-buyer edges in factors: ``vendor, class`` and ``l_class, r_class, weight, l_size, r_size``.

    Vendors with equal buyers are one class, named by its smallest vendor. Every vendor of one class has an edge of this weight to every vendor of the
    other; a row of a class with itself stands for the edges between its own vendors. The factors grow with the classes, the edges with the square of the
    vendors of a buyer: readers that only need sums, degrees or one vendor's edges take the factors, ``expand_classes`` makes the edges.
    """
    links = edges.filter(F.col("relation") == "vendor_buyer").select(F.col("src").alias("vendor"), F.col("dst").alias("buyer"))
    classes = cut(neighbour_classes(links, "vendor", "buyer"))
    heads = classes.filter(F.col("vendor") == F.col("class")).select("vendor", "size")
    head_links = links.join(heads, "vendor")
    between = pair_tiles(head_links, ["buyer"], "vendor", ["size"], block_rows).groupBy(F.col("l_vendor").alias("l_class"), F.col("r_vendor").alias("r_class")).agg(
        F.count("*").alias("weight"), F.first("l_size").alias("l_size"), F.first("r_size").alias("r_size"))
    within = classes.filter((F.col("vendor") == F.col("class")) & (F.col("size") > 1)).select(
        F.col("class").alias("l_class"), F.col("class").alias("r_class"), F.col("degree").alias("weight"), F.col("size").alias("l_size"), F.col("size").alias("r_size"))
    return classes.select("vendor", "class"), between.unionByName(within)


def expand_classes(member: DataFrame, pairs: DataFrame, block_rows: int = 2_000) -> DataFrame:
    """The edges behind the factors, each pair of vendors once: members of two classes meet in tiles of bounded size."""
    between = pairs.filter("l_class <> r_class").select(F.col("l_class").alias("lc"), F.col("r_class").alias("rc"), "weight")
    left = between.join(member.withColumnRenamed("class", "lc"), "lc").select("lc", "rc", "weight", "vendor", F.lit(0).alias("side"))
    right = between.join(member.withColumnRenamed("class", "rc"), "rc").select("lc", "rc", "weight", "vendor", F.lit(1).alias("side"))
    across = pair_tiles(left.unionByName(right), ["lc", "rc", "weight"], "vendor", block_rows=block_rows, two_sided=True)
    own = member.join(pairs.filter("l_class = r_class").select(F.col("l_class").alias("class"), "weight"), "class")
    within = pair_tiles(own, ["class", "weight"], "vendor", block_rows=block_rows)
    # within a class the smaller vendor is on the left already
    found = across.select(F.least("l_vendor", "r_vendor").alias("src"), F.greatest("l_vendor", "r_vendor").alias("dst"), "weight").unionByName(
        within.select(F.col("l_vendor").alias("src"), F.col("r_vendor").alias("dst"), "weight"))
    return found.withColumn("relation", F.lit("shared_buyer"))


def shared_buyer_edges(edges: DataFrame, block_rows: int = 2_000) -> DataFrame:
    """Vendor-vendor edges weighted by shared buyers. The pairs are the result, so all of them are formed."""
    return expand_classes(*shared_buyer_classes(edges, block_rows), block_rows)


def relationship_edges(df: DataFrame) -> DataFrame:
    edges = cut(award_edges(df))
    return edges.unionByName(shared_buyer_edges(edges))


def repeated_awards(edges: DataFrame) -> DataFrame:
    w = F.col("weight")
    return edges.filter((F.col("relation") == "vendor_buyer") & (w >= REPEAT_MIN)).select(
        F.lit("REPEATED_AWARDS").alias("signal"), F.least(w / F.lit(REPEAT_FULL), F.lit(1.0)).alias("score"),
        F.concat("src", F.lit(" repeatedly awarded by "), "dst", F.lit(" ("), w, F.lit(" records)")).alias("details"))


def tight_clusters(edges: DataFrame) -> DataFrame:
    """Large components. Shared-buyer edges never join components that share no buyer, so they are not needed."""
    comp = connected_components(edges.filter(F.col("relation") != "shared_buyer").select("src", "dst"))
    n = lambda kind: F.sum(F.when(F.col("node").startswith(kind), 1).otherwise(0))
    sizes = comp.groupBy("component").agg(F.count("*").alias("nodes"), n("vendor:").alias("v"), n("buyer:").alias("b"))
    found = sizes.filter((F.col("nodes") >= CLUSTER_NODES) & (F.col("v") >= CLUSTER_VENDORS) & (F.col("b") >= CLUSTER_BUYERS))
    return found.select(
        F.lit("TIGHT_CLUSTER").alias("signal"), F.least((F.col("v") + F.col("b")) / F.lit(CLUSTER_FULL), F.lit(1.0)).alias("score"),
        F.concat(F.lit("cluster vendors="), "v", F.lit(" buyers="), "b").alias("details"))


def betweenness(edges: DataFrame, block_rows: int = 2_000, share: float = 1.0, sources: int = centrality.SOURCES) -> DataFrame:
    """Normalized betweenness of every node, ``node, betweenness``: exact, or from a ``share`` of the nodes as sources with the error that
    ``centrality.error_bound`` states for their number.

    Nodes with equal neighbours lie on the same shortest paths, so the search runs on classes with counts:
    vendors with equal buyers (neighbours of each other), categories with equal buyers, buyers with equal
    vendors and categories.
    """
    plain = edges.filter(F.col("relation") != "shared_buyer").select("src", "dst")
    both = cut(plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    nodes = both.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    kind = F.substring_index("node", ":", 1)
    # the kind is part of the print: a vendor and a category may have the same buyers
    classes = cut(reduce(DataFrame.unionByName, [
        neighbour_classes(nodes.filter(kind == k), "node", "other") for k in ("vendor", "buyer", "category")]
    ).select("node", F.col("class").alias("c"), "size"))
    weights = classes.groupBy("c").agg(F.first("size").alias("size"), F.sum(centrality.drawn(F.col("node"), share).cast("bigint")).alias("weight"))
    heads = cut(weights.withColumn("clique", F.col("c").startswith("vendor:")))
    n, m = heads.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    links = both.join(heads.select(F.col("c").alias("src")), "src", "left_semi").join(
        classes.select(F.col("node").alias("dst"), F.col("c").alias("d")), "dst").select(F.col("src").alias("a"), F.col("d").alias("b")).distinct()
    vb = links.filter(F.col("a").startswith("vendor:")).select(F.col("a").alias("vendor"), F.col("b").alias("buyer"))
    vv = pair_tiles(vb, ["buyer"], "vendor", block_rows=block_rows).select(F.col("l_vendor").alias("a"), F.col("r_vendor").alias("b")).distinct()
    adj = cut(links.unionByName(vv).unionByName(vv.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    sums = centrality.class_betweenness(adj, heads, sources)
    scale = float(max((n - 1) * (n - 2), 1)) * (m / n if n and m else 1.0)
    return classes.join(sums, F.col("c") == F.col("t"), "left").select("node", F.coalesce(F.col("total") / F.lit(scale), F.lit(0.0)).alias("betweenness"))


def unusual_connections(edges: DataFrame) -> DataFrame:
    b = F.col("betweenness")
    return betweenness(edges).filter(F.col("node").startswith("vendor:") & (b >= BRIDGE_MIN)).select(
        F.lit("UNUSUAL_CONNECTION").alias("signal"), F.least(b * BRIDGE_FACTOR, F.lit(1.0)).alias("score"),
        F.concat("node", F.lit(" has high betweenness centrality ("), F.format_number(b, 3), F.lit(")")).alias("details"))


def detect_signals(df: DataFrame) -> DataFrame:
    """All three signals, strongest first. The shared-buyer pairs are implied, so they are not formed here."""
    edges = cut(award_edges(df))
    return repeated_awards(edges).unionByName(tight_clusters(edges)).unionByName(unusual_connections(edges)).orderBy(
        F.desc("score"), "signal", "details")
