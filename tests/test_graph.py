import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from procspark.operators import centrality, graph
from procspark.operators.components import connected_components
from procspark.operators.pairs import pair_tiles


def awards(spark, rows):
    return spark.createDataFrame(rows, "vendor string, buyer string, category string")


def random_awards(seed, n=60, vendors=18, buyers=8, cats=4):
    rnd = random.Random(seed)
    return [(f"v{rnd.randrange(vendors)}", f"b{rnd.randrange(buyers)}", f"c{rnd.randrange(cats)}") for _ in range(n)]


def test_pair_tiles_form_every_pair_once(spark):
    rows = [("g", i) for i in range(23)] + [("h", i) for i in range(3)] + [("k", 1)]
    df = spark.createDataFrame(rows, "g string, m int")
    got = [(r.g, min(r.l_m, r.r_m), max(r.l_m, r.r_m)) for r in pair_tiles(df, ["g"], "m", block_rows=4).collect()]
    want = [("g", a, b) for a in range(23) for b in range(a + 1, 23)] + [("h", a, b) for a in range(3) for b in range(a + 1, 3)]
    assert sorted(got) == sorted(want)


def test_two_sided_tiles(spark):
    rows = [("g", i, i % 2) for i in range(21)]
    got = pair_tiles(spark.createDataFrame(rows, "g string, m int, side int"), ["g"], "m", block_rows=3, two_sided=True).collect()
    assert sorted((r.l_m, r.r_m) for r in got) == sorted((a, b) for a in range(0, 21, 2) for b in range(1, 21, 2))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}") for _ in range(45)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want, seen = {}, set()
    for start in sorted(near):
        if start in seen:
            continue
        todo, group = [start], {start}
        while todo:
            for x in near[todo.pop()] - group:
                group.add(x)
                todo.append(x)
        seen |= group
        want.update({x: min(group) for x in group})
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want


def test_clustering_values_and_hubs(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b")], "vendor_id int, agency string")
    got = {r.vendor_id: r.clustering for r in graph.bipartite_clustering(graph.bipartite_edges(df)).collect()}
    assert got[1] == pytest.approx(0.75) and got[3] == pytest.approx(0.5)


@pytest.mark.parametrize("seed", range(2))
def test_clustering_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(25), f"a{rnd.randrange(6)}") for _ in range(60)]
    sets = defaultdict(set)
    for v, a in rows:
        sets[v].add(a)
    df = spark.createDataFrame(rows, "vendor_id int, agency string")
    for r in graph.bipartite_clustering(graph.bipartite_edges(df), places=8).collect():
        mine = sets[r.vendor_id]
        overlaps = [len(mine & s) / len(mine | s) for v, s in sets.items() if v != r.vendor_id and mine & s]
        assert r.clustering == pytest.approx(sum(overlaps) / len(overlaps) if overlaps else 0.0)


@pytest.mark.parametrize("vendors", [150, 1500])
def test_clustering_of_a_hub_with_distinct_sets(spark, vendors):
    """All vendors serve one agency and two more that no other vendor has together: every pair of classes overlaps in one or two agencies."""
    side = 60
    pairs = [(a, b) for a in range(side) for b in range(a)][:vendors]
    rows = [(v, f"x{x}") for v, (a, b) in enumerate(pairs) for x in ("hub", a, b)]
    with_one = defaultdict(int)
    for pair in pairs:
        for x in pair:
            with_one[x] += 1
    got = {r.vendor_id: r.clustering for r in graph.bipartite_clustering(graph.bipartite_edges(spark.createDataFrame(rows, "vendor_id int, agency string"))).collect()}
    assert len(got) == vendors
    for v, (a, b) in enumerate(pairs):
        two = with_one[a] + with_one[b] - 2
        assert got[v] == pytest.approx((two * 2 / 4 + (vendors - 1 - two) * 1 / 5) / (vendors - 1))


def test_no_row_per_pair_of_classes(spark, monkeypatch):
    """What goes between classes: rows of bits per agency and block for each class, far fewer than pairs."""
    df = spark.createDataFrame([(v, f"x{x}") for v in range(800) for x in (0, 1 + v % 30, 31 + v // 30)], "vendor_id int, agency string")
    seen = spark.sparkContext.accumulator(0)
    plain = graph._overlaps

    def counted(batches, places):
        def each():
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return plain(each(), places)

    monkeypatch.setattr(graph, "_overlaps", counted)
    graph.bipartite_clustering(graph.bipartite_edges(df)).collect()
    assert 0 < seen.value <= 800 * 3 * 5 + 200 < 800 * 799 / 2


def test_links_are_sent_packed(spark, monkeypatch):
    """What goes between tiles of classes grows with the links and the tiles, not with the links and all blocks of 256 classes."""
    rnd = random.Random(5)
    df = spark.createDataFrame([(v, f"x{rnd.randrange(60)}") for v in range(3000) for _ in range(6)], "vendor_id int, agency string")
    seen = spark.sparkContext.accumulator(0)
    plain = graph._overlaps

    def counted(batches, places):
        def each():
            for b in batches:
                seen.add(sum(len(v) for c in b.columns for v in c.to_pylist() if isinstance(v, bytes)))
                yield b
        return plain(each(), places)

    monkeypatch.setattr(graph, "_overlaps", counted)
    graph.bipartite_clustering(graph.bipartite_edges(df)).collect()
    assert 0 < seen.value <= 3000 * 7 * 6 * 16  # one row of 32 bytes for each link and block was 3000 * 6 * 14 * 32


@pytest.mark.parametrize("listed", [True, False])
def test_clustering_of_many_agencies_in_small_pieces(spark, monkeypatch, listed):
    """Common agencies listed or multiplied, over several matrices and slices of rows: the same as all pairs."""
    from procspark.operators.graph import _Tile, _listed, _multiplied
    rnd = np.random.default_rng(2)
    has = [rnd.random((n, 70)) < 0.2 for n in (40, 30)]
    for h in has:
        h[:, 0] = True
    tiles = []
    for h in has:
        agency, place = np.nonzero(h.T)
        what, times = np.unique(agency, return_counts=True)
        tiles.append(_Tile([(0, np.arange(1, len(h) + 1).tobytes(), np.ones(len(h), np.int32).tobytes(), np.arange(len(h), dtype=np.uint16).tobytes()),
                            (1, what.astype(np.int64).tobytes(), times.astype(np.int32).tobytes(), place.astype(np.uint16).tobytes())]))
    for name, value in (("_CELLS", 200), ("_SHARES", 70), ("_DENSE", 16), ("_MADE", 50)):
        monkeypatch.setattr(graph, name, value)
    real = _listed, _multiplied
    if listed:
        monkeypatch.setattr(graph, "_multiplied", lambda rows, agency, place, of_link, n, cells, held: real[0](rows, agency, tiles[1], np.arange(n), cells))
    else:
        monkeypatch.setattr(graph, "_listed", lambda rows, agency, right, kept, cells: real[1](rows, agency, *right.links(kept), len(kept), cells, {}))
    s, n, back_s, back_n = graph._meet(*tiles, False)
    common = has[0].astype(int) @ has[1].T.astype(int)
    share = common / (has[0].sum(1)[:, None] + has[1].sum(1) - common)
    size = [np.arange(1, len(h) + 1) for h in has]
    assert np.allclose(s, share @ size[1]) and np.allclose(back_s, size[0] @ share)
    assert np.allclose(n, (common > 0) @ size[1]) and np.allclose(back_n, size[0] @ (common > 0))


def test_co_occurrence(spark):
    rows = [(v, "a", "2026-01-05") for v in (1, 2, 3)] + [(1, "a", "2026-01-08"), (4, "b", "2026-01-08")]
    df = spark.createDataFrame(rows, "vendor_id int, agency string, ts string").selectExpr("vendor_id", "agency", "cast(ts as timestamp_ntz) ts")
    assert {r.vendor_id: (r.co_count, r.co_score) for r in graph.co_occurrence(df).collect()} == {1: (2, 1.0), 2: (2, 1.0), 3: (2, 1.0)}


def test_repeated_awards(spark):
    row = graph.repeated_awards(graph.award_edges(awards(spark, [("v1", "b1", "c")] * 5))).first()
    assert (row.signal, row.score) == ("REPEATED_AWARDS", 0.25) and "(5 records)" in row.details


def test_tight_cluster(spark):
    rows = [(f"v{i}", f"b{i % 3}", "c") for i in range(8)]
    found = graph.tight_clusters(graph.award_edges(awards(spark, rows))).collect()
    assert [r.score for r in found] == [pytest.approx(11 / 25)]
    assert graph.tight_clusters(graph.award_edges(awards(spark, rows[:5]))).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_shared_buyers(spark, seed):
    rows = random_awards(seed)
    buyers = defaultdict(set)
    for v, b, _ in rows:
        buyers[f"vendor:{v}"].add(b)
    vs = sorted(buyers)
    want = sorted((a, b, len(buyers[a] & buyers[b])) for i, a in enumerate(vs) for b in vs[i + 1:] if buyers[a] & buyers[b])
    got = graph.shared_buyer_edges(graph.award_edges(awards(spark, rows)), block_rows=4).collect()
    assert sorted((r.src, r.dst, r.weight) for r in got) == want


def test_factors_hold_all_shared_buyer_edges(spark):
    """A buyer of many vendors that behave alike is a few rows; weights and numbers of edges follow from the factors."""
    rows = [(f"v{i}", "hub", "c") for i in range(200)] + [(f"v{i}", f"b{i % 3}", "c") for i in range(90)]
    edges = graph.award_edges(awards(spark, rows))
    member, pairs = graph.shared_buyer_classes(edges)
    kinds = pairs.collect()
    assert member.count() == 200 and len(kinds) == 4 + 6  # three classes of 30 and one of 110: each with itself and with the others
    assert sum(r.l_size * r.r_size if r.l_class != r.r_class else r.l_size * (r.l_size - 1) // 2 for r in kinds) == graph.shared_buyer_edges(edges).count() == 200 * 199 // 2


def brandes(near):
    score = dict.fromkeys(near, 0.0)
    for s in near:
        order, pred, paths, dist = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    pred[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


@pytest.mark.parametrize("rows", [
    random_awards(0, 22, 14, 9, 3), random_awards(1, 40), [(f"v{i}", f"b{i // 4}", "c") for i in range(12)] + [("v0", "b2", "d"), ("v0", "b2", "e")],
    [("v1", "b1", "c1"), ("v1", "b1", "c2"), ("v2", "b2", "c2"), ("v9", "b9", "c9")]])
@pytest.mark.parametrize("sources", [3, 256])
def test_betweenness_is_exact(spark, rows, sources):
    near = neighbours(rows)
    want = brandes(near)
    got = {r.node: r.betweenness for r in graph.betweenness(graph.award_edges(awards(spark, rows)), block_rows=3, sources=sources).collect()}
    assert set(got) == set(want)
    for node, x in want.items():
        assert got[node] == pytest.approx(x, abs=1e-12), node


def test_betweenness_from_a_share_of_sources(spark):
    rows = random_awards(3, 400, 150, 60, 8)
    want = brandes(neighbours(rows))
    got = {r.node: r.betweenness for r in graph.betweenness(graph.award_edges(awards(spark, rows)), share=0.4, sources=16).collect()}
    drawn = sum(r.x for r in spark.createDataFrame([(v,) for v in want], "node string").select(centrality.drawn(F.col("node"), 0.4).cast("int").alias("x")).collect())
    assert 0.2 * len(want) < drawn < 0.6 * len(want) and set(got) == set(want)
    assert max(abs(got[v] - want[v]) for v in want) <= centrality.error_bound(drawn, 0.01) and any(got[v] != want[v] for v in want)


def test_betweenness_of_nothing(spark):
    assert graph.betweenness(graph.award_edges(awards(spark, []))).count() == 0


def neighbours(rows):
    near, by_buyer = defaultdict(set), defaultdict(set)
    for v, b, c in rows:
        v, b, c = f"vendor:{v}", f"buyer:{b}", f"category:{c}"
        near[v].add(b)
        near[b] |= {v, c}
        near[c].add(b)
        by_buyer[b].add(v)
    for vs in by_buyer.values():
        for v in vs:
            near[v] |= vs - {v}
    return near


def test_edges_are_made_once_for_sizes_and_overlaps(spark):
    """The records behind the edges are read once, however often the edges are."""
    rows = [(v, f"a{(v * k) % 7}") for v in range(40) for k in range(3)]
    for measure in (graph.component_size, graph.bipartite_clustering):
        read = spark.sparkContext.accumulator(0)

        def seen(batches, read=read):
            for b in batches:
                read.add(b.num_rows)
                yield b

        df = spark.createDataFrame(rows, "vendor_id bigint, agency string").mapInArrow(seen, "vendor_id bigint, agency string")
        assert measure(graph.bipartite_edges(df)).count() == 40
        assert read.value == len(rows)


def test_an_invoice_line_moves_once_to_its_agency(spark):
    """The agency joins the orders; only then do the lines, which are the most rows, meet them."""
    from procspark.sources.tables import spend
    plan = spend(spark, "/root/testdata/sf0.001", agency=True)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join Inner" in line]
    level = lambda i: len(plan[i]) - len(plan[i].lstrip(" :+-|"))
    line_scan = max(i for i, text in enumerate(plan) if "Relation" in text and "l_orderkey" in text)
    above = [i for i in joins if i < line_scan and level(i) < level(line_scan)]
    assert len(above) == 1, "\n".join(plan)
    assert not any("concat_ws" in line for line in plan[above[0] + 1:])  # and its text id is made after that
