"""Impacts from tables of groups of leaves against the leaves one by one."""

import math

import numpy as np
import pandas as pd
import pytest

from procspark.operators import forest


def grown(seed, rows=200, cols=5, trees=6):
    rng = np.random.default_rng(seed)
    return [(lambda t: {"tree": i, **t})(forest._grow(rng.normal(size=(rows, cols)).round(1), np.random.default_rng([seed, i]), 8)) for i in range(trees)]


def leaf_by_leaf(columns, arrays):
    total = np.zeros(columns.shape)
    for tree in arrays:
        leaves = forest._leaves(tree)
        for (feats, bounds, length), table in zip(leaves, forest._tables(leaves)):
            code = np.zeros(columns.shape[1], dtype=int)
            for bit, (f, (low, high, _)) in enumerate(zip(feats, bounds)):
                code |= (((columns[f] > low) | math.isinf(low)) & (columns[f] <= high)).astype(int) << bit
            for f, values in zip(feats, table if feats else ()):
                total[f] -= (length / len(arrays) * values)[code]
    return total


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bits", [1, 5, 9])
def test_groups_give_the_leaves_sums(seed, bits, monkeypatch):
    monkeypatch.setattr(forest, "_CHUNK", 300)
    model = forest.Forest(grown(seed), 200, list("abcde"))
    arrays = forest._arrays(model)
    columns = np.random.default_rng(9).normal(size=(5, 1000)).round(1)
    columns[2, :2] = math.inf, -math.inf
    plans = [forest._plan(t, bits) for t in arrays]
    tables = [forest._group_tables(forest._leaves(t), groups, 1 / len(arrays)) for t, (_, groups) in zip(arrays, plans)]
    assert np.allclose(forest._explained(columns, plans, tables), leaf_by_leaf(columns, arrays), rtol=0, atol=1e-12)


def test_few_look_ups_serve_all_leaves():
    arrays = forest._arrays(forest.Forest(grown(4), 200, list("abcde")))
    leaves = [leaf for t in arrays for leaf in forest._leaves(t)]
    plans = [forest._plan(t) for t in arrays]
    for tree, (_, groups) in zip(arrays, plans):
        assert [at for _, _, members in groups for at, _ in members] == list(range(len(forest._leaves(tree))))
    assert 2 * sum(len(feats) for _, groups in plans for _, feats, _ in groups) < sum(len(feats) for feats, _, _ in leaves)


def test_rows_are_sent_once(spark):
    """Rows that come in enough tasks are not moved; values that are shown as they are scored are sent once."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(400, 5)), columns=list("abcde")).assign(tx_id=[f"t{i}" for i in range(400)])
    model = forest.Forest(grown(5), 200, list("abcde"))
    out = forest.attributions(spark.createDataFrame(pdf).repartition(8), model)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "shown" not in plan
    missing = spark.createDataFrame([("n", float("nan"), 0.0, 0.0, 0.0, 0.0)], "tx_id string, a double, b double, c double, d double, e double")
    r = forest.attributions(missing, model, raw=list("abcde")).first()
    path = -math.log2(-forest.sample_score(missing, model).first()["sample_score"]) * float(forest.average_path(200))
    assert r.expected + sum(a.impact for a in r.attributions) == pytest.approx(-path, abs=1e-9)
