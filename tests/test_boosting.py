"""Boosted trees against a plain loop over the rows, and the forest's samples."""

import math

import numpy as np
import pandas as pd
import pytest

from procspark.operators import classifier, forest

EDGES = {"a": [-1.0, -0.5, 0.0, 0.5, 1.0], "b": [-0.8, 0.1, 0.9], "c": [1.0]}


def rows_of(n=500, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(label=(x[:, 0] - x[:, 1] + rng.normal(size=n) > 1).astype(int), tx_id=[f"t{i}" for i in range(n)])
    pdf.loc[::17, "b"] = np.nan
    return pdf


def plain_fit(pdf, rounds, depth, step=0.05):
    """Trees as nested tuples; every sum is a loop over rows."""
    rows = [dict(zip("abc", map(float, r[:3])), y=int(r[3])) for r in pdf[["a", "b", "c", "label"]].itertuples(index=False)]
    pos = sum(r["y"] for r in rows)
    margin, trees = [0.0] * len(rows), []
    soft = lambda g: math.copysign(max(abs(g) - 0.1, 0.0), g)
    score = lambda g, h: soft(g) ** 2 / (h + 2.0)

    def grow(ids, left):
        g, h = sum(grad[i] for i in ids), sum(hess[i] for i in ids)
        best = (1e-6, None)
        for c in "abc" if left else "":
            for e in EDGES[c]:
                below = [i for i in ids if rows[i][c] <= e]
                gl, hl = sum(grad[i] for i in below), sum(hess[i] for i in below)
                if hl >= 5 and h - hl >= 5:
                    gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
                    if gain > best[0] + 1e-9:
                        best = (gain, (c, e))
        if best[1] is None:
            return -step * soft(g) / (h + 2.0)
        c, e = best[1]
        return c, e, grow([i for i in ids if rows[i][c] <= e], left - 1), grow([i for i in ids if not rows[i][c] <= e], left - 1)

    def value(tree, r):
        while isinstance(tree, tuple):
            tree = tree[2] if r[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        w = [(len(rows) - pos) / pos if r["y"] else 1.0 for r in rows]
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad, hess = [(q - r["y"]) * k for q, r, k in zip(p, rows, w)], [q * (1 - q) * k for q, k in zip(p, w)]
        trees.append(grow(range(len(rows)), depth))
        margin = [m + value(trees[-1], r) for m, r in zip(margin, rows)]
    return [1 / (1 + math.exp(-m)) for m in margin]


def test_trees_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(classifier, "FROZEN_ROUNDS", 2)  # margins are written in between
    pdf = rows_of()
    df = spark.createDataFrame(pdf)
    model = classifier.fit(df, list("abc"), rounds=5, depth=3, row_share=1.0, column_share=1.0, edges=EDGES)
    got = classifier.probability(df, model, list("abc")).toPandas().set_index("tx_id").probability
    assert np.allclose(got.loc[pdf.tx_id].to_numpy(), plain_fit(pdf, 5, 3), atol=1e-6)


def test_tasks_do_not_change_the_trees(spark, monkeypatch):
    df = spark.createDataFrame(rows_of())
    one = classifier.fit(df, list("abc"), rounds=3, key="tx_id")
    monkeypatch.setattr(classifier, "TASK_ROWS", 60)
    many = classifier.fit(df.repartition(7), list("abc"), rounds=3, key="tx_id")
    assert one.trees == many.trees and any(f >= 0 for f in one.trees[0]["feature"])


def test_shares_of_rows_and_no_rows(spark):
    key = np.arange(20_000, dtype=np.int64) * 7919
    first, second = classifier._drawn(key, 0, 0.8), classifier._drawn(key, 1, 0.8)
    assert abs(first.mean() - 0.8) < 0.02 and abs((first & second).mean() - 0.64) < 0.02
    df = spark.createDataFrame(rows_of())
    nothing = classifier.fit(df.limit(0), list("abc"), rounds=3)
    assert set(classifier.probability(df, nothing, list("abc")).toPandas().probability) == {0.5}
    same = classifier.fit(df.filter("label = 0"), list("abc"), rounds=2)  # one label only
    assert classifier.probability(df, same, list("abc")).toPandas().probability.between(0, 1).all()


def test_held_out_f1(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "label int, probability double")
    assert classifier.held_out_f1(df) == pytest.approx(0.5)
    assert classifier.held_out_f1(df.filter("probability < 0.2")) == 0.0


@pytest.mark.parametrize("n", [10, 256, 5000])
def test_every_tree_has_its_full_sample(spark, n):
    df = spark.createDataFrame([(f"k{i}", float(i)) for i in range(n)], "tx_id string, v double")
    got, rows = forest.sample_rows(df, "tx_id", ["v"], 12, 256, 1)
    pdf = got.toPandas()
    assert rows == n and (pdf.groupby("tree").size() == min(n, 256)).all() and pdf.tree.nunique() == 12
    assert not pdf.duplicated(["tree", "key"]).any()
    if n == 5000:
        sets = pdf.groupby("tree")["key"].apply(set)
        assert max(len(a & b) for i, a in enumerate(sets) for b in sets[:i]) < 60  # 13 expected
        again = forest.sample_rows(df.repartition(9), "tx_id", ["v"], 12, 256, 1)[0].toPandas()
        assert sorted(zip(pdf.tree, pdf.place, pdf["key"])) == sorted(zip(again.tree, again.place, again["key"]))


def test_draws_with_replacement():
    rng = np.random.default_rng(3)
    distinct = [len(set(forest.draws(256, 400, 256, rng))) for _ in range(300)]
    assert abs(np.mean(distinct) - 400 * (1 - (1 - 1 / 400) ** 256)) < 2
    assert set(forest.draws(5, 5, 1000, rng)) == set(range(5))


def test_few_rows_take_few_jobs(spark, monkeypatch):
    """A table that one task holds grows all its trees in one job, and the trees are those of the passes level by level."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(label=(x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int), k=range(150))
    df = spark.createDataFrame(pdf)
    sc = spark.sparkContext
    sc.setJobGroup("few-rows", "boosting")
    try:
        here = classifier.fit(df, list("abcd"), rounds=6, key="k")
        jobs = len(sc.statusTracker().getJobIdsForGroup("few-rows"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 15
    monkeypatch.setattr(classifier, "TASK_ROWS", 50)
    assert classifier.fit(df, list("abcd"), rounds=6, key="k").trees == here.trees
