"""What runs over all invoices leave on disk: few rows are ranked for quantiles, wide tables end with their run."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from procspark import session
from procspark.operators import augment, evaluate
from procspark.plans import run_queries


def test_quantiles_rank_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.lognormal(size=20_000), "b": rng.integers(0, 2, 20_000).astype(float)})
    ranked = []
    sums = evaluate.running_sums
    monkeypatch.setattr(evaluate, "running_sums", lambda df, *a: ranked.append(df.count()) or sums(df, *a))
    got = {(r.feature, r.prob): r.value for r in evaluate.exact_quantiles(spark.createDataFrame(pdf), ["a", "b"], [0.1, 0.5, 0.9]).collect()}
    assert ranked[0] < 500
    for c in "ab":
        for p in (0.1, 0.5, 0.9):
            assert np.isclose(got[c, p], np.quantile(pdf[c], p), rtol=1e-12)


def test_quantiles_where_a_sketch_misleads(spark, monkeypatch):
    """Ends that do not hold the rank are left open; NaN lies above all numbers, nulls do not count."""
    monkeypatch.setattr(evaluate, "_between", lambda df, cols, probs, slack: [[(5.0, 4.0), (50.0, 60.0), (200.0, 300.0)]])
    values = [float(v) for v in range(101)] + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "a double")
    assert [r.value for r in evaluate.exact_quantiles(df, ["a"], [0.1, 0.5, 0.9]).orderBy("prob").collect()] == [10.0, 50.0, 90.0]
    monkeypatch.undo()
    odd = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("nan"),), (float("nan"),)], "a double")
    got = [r.value for r in evaluate.exact_quantiles(odd, ["a"], [0.0, 0.25, 1.0]).orderBy("prob").collect()]
    assert got[:2] == [1.0, 2.0] and np.isnan(got[2])
    assert evaluate.exact_quantiles(df.filter("a < 0"), ["a"], [0.5]).count() == 0


def test_held_tables_end_with_their_block(spark):
    before = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    with session.scratch(spark) as hold:
        held = hold(spark.range(1000).withColumn("x", F.col("id") % 7).repartition(3, "x"))
        folder = os.path.dirname(held.inputFiles()[0].removeprefix("file://"))
        assert held.agg(F.sum("x")).first()[0] == sum(i % 7 for i in range(1000))
    assert not os.path.exists(folder) and spark.conf.get(session.SHUFFLE_CLEANUP, None) == before


def test_training_holds_its_features_in_scratch(spark, monkeypatch):
    """The features are never cut as they are: what is left in the shared folder are narrow tables."""
    wide = []
    for module in (session, run_queries, run_queries.feat, augment):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", lambda df, cut=session.cut: wide.append(len(df.columns)) or cut(df))
    with session.scratch(spark) as hold:
        rows = run_queries._with_labelled(spark, "/root/testdata/sf0.001", 555, hold)
        assert rows.filter("label is not null").count() > 0
    assert wide and max(wide) < 10


def test_no_history_is_made_for_dense_vendors(spark, monkeypatch):
    seen = []
    expand = augment.expand_vendor_history
    monkeypatch.setattr(augment, "expand_vendor_history", lambda df, *a: seen.append(df.count()) or expand(df, *a))
    rows = spark.sql("select id % 3 as vendor_id, id * 100 as cents, timestamp_ntz'2024-01-01' as ts from range(90)")
    assert augment.augment_cap(rows).count() == 0 and seen == [0]
