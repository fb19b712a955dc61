import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from procspark.operators import augment, classifier, evaluate, forest


def scored(spark, seed=0, n=300):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 40, n) / 40.0
    y = (rng.random(n) < s).astype(int)
    return s, y, spark.createDataFrame(pd.DataFrame({"score": s, "label": y}))


def test_areas_and_sweep(spark):
    s, y, df = scored(spark)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert evaluate.roc_auc(df, n_slices=7).first()[0] == pytest.approx(want)
    points = [(0.0, 1.0)] + [(y[s >= t].sum() / y.sum(), y[s >= t].mean()) for t in sorted(set(s), reverse=True)]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert evaluate.pr_auc(df, n_slices=7).first()[0] == pytest.approx(area)
    for r in evaluate.threshold_sweep(df).collect():
        flagged = s >= min(evaluate.THRESHOLDS, key=lambda t: abs(t - r.threshold))
        assert r.precision == pytest.approx(y[flagged].mean() if flagged.any() else 1.0, abs=6e-4)


def test_nothing_flagged_and_floor(spark):
    df = spark.createDataFrame([(0.3, 1), (0.2, 0)], "score double, label int")
    rows = {r.threshold: r for r in evaluate.threshold_sweep(df).collect()}
    assert (rows[0.95].precision, rows[0.95].recall, rows[0.95].f1) == (1.0, 0.0, 0.0)
    assert evaluate.optimal_threshold(evaluate.threshold_sweep(df)).first().threshold == 0.25


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.integers(0, 20, 501) / 4.0, "b": rng.normal(size=501), "c": 1.0})
    got = {(r.feature, r.prob): r.value for r in evaluate.exact_quantiles(spark.createDataFrame(pdf), ["a", "b", "c"], [0.1, 0.5, 0.93], 5).collect()}
    for (c, p), v in got.items():
        assert v == pytest.approx(np.quantile(pdf[c], p))
    scaled = evaluate.robust_scale(spark.createDataFrame(pdf), ["a", "c"]).toPandas()
    assert scaled.c.eq(0).all() and scaled.a.median() == 0


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3))
    x[:10] += 9
    pdf = pd.DataFrame(x, columns=list("abc")).assign(tx_id=[f"{i:05d}" for i in range(2000)])
    df = spark.createDataFrame(pdf)
    return df, forest.fit(df, "tx_id", list("abc"), trees=60)


def test_planted_rows_score_lowest(planted):
    df, model = planted
    out = forest.sample_score(df, model)
    pdf = out.toPandas()
    assert pdf.sample_score.between(-1, 0).all()
    assert set(pdf.nsmallest(10, "sample_score").tx_id) == {f"{i:05d}" for i in range(10)}
    off = forest.offset_for(out, 0.005)
    assert forest.decision(out, off).filter("decision < 0").count() <= 10


def test_forest_does_not_depend_on_partitions(planted):
    df, model = planted
    again = forest.fit(df.repartition(13), "tx_id", list("abc"), trees=60)
    assert again.trees == model.trees


def test_tables_of_leaves_are_shapley_values():
    """Leaves of one to five conditions: every hit pattern's values are the means over all orders, and leaves of a tree share their tests."""
    from itertools import permutations
    rng = np.random.default_rng(3)
    leaves = [(list(range(m)), [(-np.inf, 0.0, float(s)) for s in rng.random(m)], 1.0) for m in (1, 2, 3, 5, 5)] + [([], [], 2.0)]
    tables = forest._tables(leaves)
    assert tables[-1] is None
    for (feats, bounds, _), table in zip(leaves[:-1], tables):
        m = len(feats)
        assert table.shape == (m, 1 << m)
        for pattern in range(1 << m):
            hit = [pattern >> i & 1 for i in range(m)]
            want = np.zeros(m)
            for order in permutations(range(m)):
                value = np.array([b[2] for b in bounds])
                for i in order:
                    before = value.prod()
                    value[i] = hit[i]
                    want[i] += value.prod() - before
            assert np.allclose(table[:, pattern], want / math.factorial(m))


def test_attributions_take_one_pass_of_look_ups(planted, monkeypatch):
    """The patterns of a batch are not sorted leaf by leaf; rows without a number or at an end of the line are explained as they are scored."""
    df, model = planted
    monkeypatch.setattr(np, "unique", None)
    spark = df.sparkSession
    odd = spark.createDataFrame([("inf", float("inf"), 0.0, 0.0), ("low", float("-inf"), 0.0, 0.0), ("far", -1e300, 0.0, 0.0)], "tx_id string, a double, b double, c double")
    got = {r.tx_id: [(a.feature, round(a.impact, 9)) for a in r.attributions] for r in forest.attributions(odd, model).collect()}
    assert got["low"] == got["far"] and got["inf"] != got["low"]


def test_attributions_add_up(planted):
    df, model = planted
    few = df.limit(40)
    got = forest.attributions(few, model).toPandas().set_index("tx_id")
    score = forest.sample_score(few, model).toPandas().set_index("tx_id").sample_score
    path = -np.log2(-score) * float(forest.average_path(model.sample))
    for tx, r in got.iterrows():
        assert r.expected + sum(a["impact"] for a in r.attributions) == pytest.approx(-path[tx], abs=1e-9)
        sizes = [abs(a["impact"]) for a in r.attributions]
        assert sizes == sorted(sizes, reverse=True)
    assert sum(a["impact"] for a in got.loc["00000"].attributions) > 0


def test_classifier_and_split(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(label=(x[:, 0] + x[:, 1] > 1).astype(int), tx_id=range(600))
    df = classifier.stratified_split(spark.createDataFrame(pdf), "tx_id")
    share = df.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.12 < share < 0.28
    model = classifier.fit(df.filter("not is_test"), ["a", "b"], rounds=4)
    out = classifier.probability(df.filter("is_test"), model, ["a", "b"]).select("label", F.col("probability").alias("score"))
    assert evaluate.roc_auc(out).first()[0] > 0.9


def history(spark, vendors=6, n=5):
    rows = [(v, f"{v}-{i}", 100_000 * (v + 1) + i, f"2024-01-{i + 1:02d}") for v in range(vendors) for i in range(n)]
    return spark.createDataFrame(rows, "vendor_id bigint, tx_id string, cents bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_history_walks_back(spark):
    real = history(spark)
    rows = augment.expand_vendor_history(real, 15).toPandas()
    assert len(rows) == 6 * 15 and (rows.cents >= 10_000).all() and rows.ts.max() < pd.Timestamp("2024-01-01")
    gaps = rows.sort_values("ts").groupby("vendor_id").ts.diff().dropna().dt.days
    assert gaps.between(11, 93).all()
    pd.testing.assert_frame_equal(rows.sort_values("tx_id", ignore_index=True),
                                  augment.expand_vendor_history(real.repartition(5), 15).toPandas().sort_values("tx_id", ignore_index=True))


def test_injected_patterns(spark):
    rows = augment.inject_labeled_anomalies(history(spark)).toPandas()
    counts = rows.anomaly_type.value_counts()
    assert counts.to_dict() == {"NORMAL": 300, "BURST_24H": 60, "WEEKEND_SPIKE": 50, "VELOCITY_SPIKE": 50, "RATIO_OUTLIER": 50, "ROUND_NUMBER": 50,
                                "APPROVAL_LIMIT": 50, "SPLIT_BILLING": 48}
    assert (rows.label == (rows.anomaly_type != "NORMAL")).all() and rows.ts.min() > pd.Timestamp("2024-01-05") and rows.vendor_id.notna().all()
    assert rows[rows.anomaly_type == "WEEKEND_SPIKE"].ts.dt.dayofweek.isin([4, 5]).all()
    assert rows[rows.anomaly_type == "SPLIT_BILLING"].cents.between(920_000, 998_000).all()
    assert rows[rows.anomaly_type == "ROUND_NUMBER"].cents.isin([int(a * 100) for a in augment.ROUND_AMOUNTS]).all()
    assert rows.vendor_id.nunique() == 6


def test_cap(spark):
    assert augment.augment_cap(history(spark, 6, 20)).count() == 0
    assert augment.augment_cap(history(spark, 6, 5)).count() == 96
