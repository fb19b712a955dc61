import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from procspark.operators import text, vectors

CONTRACT = "\n".join(f"{i}.{j} Terms\nThe vendor shall deliver part {i}{j}. " + "Payment is due within thirty days of invoice receipt. " * 6 for i in range(1, 4) for j in range(1, 4))


def test_chunks(spark):
    df = spark.createDataFrame([("c1", CONTRACT, "s"), ("c2", "short", "s"), ("c3", None, "s"), ("c4", "x" * 1500, "s")], "contract_id string, text string, source string")
    rows = text.chunk_text(df, "contract_id", "text", ["source"]).collect()
    mine = sorted((r for r in rows if r.contract_id == "c1"), key=lambda r: r.chunk_index)
    assert len(mine) >= 3 and [r.chunk_index for r in mine] == list(range(len(mine))) and mine[0].source == "s"
    for r in mine:
        assert 40 <= len(r.text) <= 600 and CONTRACT[r.start_index:].startswith(r.text)
    covered = set()
    for r in mine:
        covered |= set(range(r.start_index, r.start_index + len(r.text)))
    assert all(i in covered or CONTRACT[i].isspace() for i in range(len(CONTRACT)))
    assert [r.contract_id for r in rows if r.contract_id != "c1"] == ["c4"] and len([r for r in rows if r.contract_id == "c4"][0].text) == 1500


@pytest.mark.parametrize("seed", range(5))
def test_chunks_of_random_text(seed):
    rnd = random.Random(seed)
    body = "".join(rnd.choice(["word ", "a", ". ", "\n", "\n\n", "\n1.2 X", "longerword"]) for _ in range(800))
    got = text.chunks_of(body, 100, 20, 0)
    assert [c[0] for c in got] == list(range(len(got)))
    for _, start, piece in got:
        assert body[start:start + len(piece)] == piece
    ends = 0
    for _, start, piece in got:
        assert not body[ends:start].strip()
        ends = max(ends, start + len(piece))


def test_same_content_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, text string")
    stored = spark.createDataFrame([("c",)], "t string").select(F.sha2("t", 256).alias("file_hash"))
    assert sorted(r.id for r in text.content_hash_dedup(df, "text", "id", stored).collect()) == [1, 3]


def store(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, i % 4, [float(x) for x in v[i]]) for i in range(n)]
    return v, spark.createDataFrame(rows, "chunk_id int, contract_id int, vec array<float>")


def test_topk_blocks_give_the_same(spark, monkeypatch):
    v, df = store(spark)
    queries = df.filter("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "vec", "contract_id")
    one = sorted(tuple(r) for r in vectors.vector_topk(df, queries, 3).select("query_id", "chunk_id", "rank").collect())
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert one == sorted(tuple(r) for r in vectors.vector_topk(df, queries, 3).select("query_id", "chunk_id", "rank").collect())
    for q in range(7):
        best = [i for i in np.argsort(-(v @ v[q])) if v[i] @ v[q] >= 0.2][:3]
        assert [c for qq, c, _ in sorted(one, key=lambda r: (r[0], r[2])) if qq == q] == best
    assert vectors.vector_topk(df.limit(0), queries, 3).count() == 0


def test_filter_comes_before_ranking(spark):
    v, df = store(spark)
    queries = df.filter("chunk_id < 4").select(F.col("chunk_id").alias("query_id"), "vec", F.lit(2).alias("contract_id"))
    for r in vectors.vector_topk_filtered(df, queries, 3).collect():
        assert r.contract_id == 2
    found = vectors.vector_topk_filtered(df, queries, 3).filter("query_id = 0").orderBy("rank").collect()
    want = [i for i in np.argsort(-(v @ v[0])) if i % 4 == 2 and v[i] @ v[0] >= 0.2][:3]
    assert [r.chunk_id for r in found] == want


@pytest.mark.parametrize("part_rows, query_rows", [(50_000, 1_000), (7, 3)])
def test_groups_are_split_and_stay_exact(spark, part_rows, query_rows, monkeypatch):
    """One group holds most chunks and most queries; another has no queries, a third no chunks. Text ids, ties and nulls."""
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(90, 8)), 1)
    v[5] = v[3]
    group = ["big" if i % 6 else f"g{i % 4}" for i in range(90)]
    chunks = [(g, f"c{i:02d}", [float(x) for x in v[i]]) for i, g in enumerate(group)] + [("none asks", "c98", [1.0] * 8), ("big", "c99", None)]
    asked = [(g, i, [float(x) for x in v[i]]) for i, g in enumerate(group)] + [("no chunks", 1000, [1.0] * 8), ("big", 1001, None)]
    monkeypatch.setattr(vectors, "_CELLS", 64)
    found = vectors._part_topk(spark.createDataFrame(chunks, "grp string, chunk_id string, vec array<double>"),
                               spark.createDataFrame(asked, "grp string, query_id int, vec array<double>"), 3, 0.2, part_rows, query_rows)
    got = {}
    for r in vectors._ranked(found, ["grp", "query_id"], 3).collect():
        got.setdefault((r.grp, r.query_id), []).append((r.rank, r.chunk_id, round(r.score, 9)))
    for i, g in enumerate(group):
        scores = sorted((-round(float(v[i] @ v[j]), 9), f"c{j:02d}") for j in range(90) if group[j] == g and v[i] @ v[j] >= 0.2)[:3]
        assert sorted(got.pop((g, i), [])) == [(k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    assert not got


def test_clauses_of_vendors_with_equal_contracts(spark):
    v, df = store(spark, 80)
    chunks = df.select("chunk_id", "contract_id", "vec")
    contracts = spark.createDataFrame([(vendor, c, "ACTIVE" if (vendor, c) != (3, 1) else "EXPIRED", c != 2) for vendor in range(6) for c in range(4) if (vendor + c) % 3],
                                      "vendor_id int, contract_id int, status string, is_indexed boolean")
    queries = df.filter("chunk_id < 10").select(F.col("chunk_id").alias("query_id"), "vec")
    tx = [(f"t{i}", i % 7, i % 11) for i in range(60)]
    got = {}
    for r in vectors.clause_retrieval(spark.createDataFrame(tx, "tx_id string, vendor_id int, query_id int"), queries, contracts, chunks).collect():
        got.setdefault(r.tx_id, []).append((r["rank"], r.contract_id, r.chunk_id))
    for name, vendor, q in tx:
        mine = [c for c in range(4) if vendor < 6 and (vendor + c) % 3 and (vendor, c) != (3, 1) and c != 2]
        best = []
        if q < 10:
            for c in mine:
                best += sorted((-(v[j] @ v[q]), j, c) for j in range(80) if j % 4 == c and v[j] @ v[q] >= 0.2)[:2]
        assert sorted(got.pop(name, [])) == [(k + 1, c, j) for k, (_, j, c) in enumerate(sorted(best)[:3])]


def test_delete(spark):
    rows = [(i, "A" if i < 4 else "B") for i in range(7)]
    rest, removed = vectors.vector_delete(spark.createDataFrame(rows, "chunk_id int, contract_id string"), spark.createDataFrame([("A",)], "contract_id string"))
    assert rest.count() == 3 and removed.first().removed == 4


def test_many_queries_are_not_broadcast_and_sent_to_few_parts(spark):
    """Three queries for every vector: neither side is collected to the driver, and a vector moves far fewer times than there are tasks and blocks of queries."""
    v, df = store(spark, 4000, 3)
    times = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("m")
    queries = df.select("chunk_id", "vec", times).select((F.col("chunk_id") * 3 + F.col("m")).alias("query_id"), "vec")
    plain, seen = vectors._best, spark.sparkContext.accumulator(0)

    def counted(x, matrix, *rest):
        seen.add(len(x))
        return plain(x, matrix, *rest)

    vectors._best = counted
    try:
        out = vectors.vector_topk(df, queries, 3, 0.3)
        plan = out._jdf.queryExecution().toString()
        got = {}
        for r in out.collect():
            got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    finally:
        vectors._best = plain
    for line in plan.split("BroadcastExchange")[1:]:
        assert "embedding" not in line.split("\n")[1] and "vec#" not in line.split("\n")[1]
    assert 12_000 <= seen.value <= 12_000 * 2
    w = v.astype(np.float32).astype(float)
    for q in range(0, 12_000, 997):
        s = w @ w[q // 3]
        assert [c for _, c in sorted(got[q])] == [i for i in np.lexsort((np.arange(4000), -s)) if s[i] >= 0.3][:3]


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e17])
def test_best_products_by_stripes(spark, scale):
    """Close scores, equal vectors and numbers out of single precision: the same as sorting all products."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(700, 6)) * scale
    m[300:600] = m[:300] * (1 + 1e-9 * rng.integers(0, 2, size=(300, 1)))
    x = m[::50] + 0.0
    held = {}
    row, col, score = vectors._best(x, m, np.arange(700), 3, 0.1 * scale * scale, held)
    again = vectors._best(x, m, np.arange(700), 3, 0.1 * scale * scale, held)
    assert all((a == b).all() for a, b in zip(again, (row, col, score)))
    for i, one in enumerate(x):
        s = (one * m).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(700), -s)) if s[j] >= 0.1 * scale * scale][:3]
        assert col[row == i].tolist() == want
