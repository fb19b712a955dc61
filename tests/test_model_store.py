import numpy as np

from procspark.operators import models
from procspark.operators.features import FEATURES


def rows(spark, n, seed, label=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(FEATURES)))
    y = (x[:, 0] + x[:, 1] > 1.5).astype(int)
    x[y == 1] *= 4
    data = [(f"t{seed}-{i}", *map(float, x[i]), *([int(y[i])] if label else [])) for i in range(n)]
    return spark.createDataFrame(data, "tx_id string, " + ", ".join(f"{c} double" for c in FEATURES) + (", label int" if label else ""))


def test_a_saved_model_scores_as_before(spark, tmp_path):
    model = models.train(rows(spark, 400, 1), rows(spark, 200, 2, True), "tx_id", [0.05, 0.1], trees=20, rounds=3)
    assert model.contamination in (0.05, 0.1)
    models.save(model, spark, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    new = rows(spark, 100, 3, True)
    a, b = ({r.tx_id: r.ml_score for r in models.apply(new, m).collect()} for m in (model, again))
    assert a == b and len(a) == 100
    out = models.apply(new, again).toPandas()
    assert out[out.label == 1].ml_score.mean() > out[out.label == 0].ml_score.mean() + 0.1
    assert set(FEATURES) <= set(out.columns) and "stage_one" not in out.columns


def test_without_labels_there_is_no_second_stage(spark, tmp_path):
    model = models.train(rows(spark, 300, 4), None, "tx_id", [0.05], trees=10)
    models.save(model, spark, str(tmp_path / "m"))
    got = models.apply(rows(spark, 50, 5), models.load(spark, str(tmp_path / "m"))).collect()
    assert all(r.probability is None and 0 <= r.ml_score <= 1 for r in got)
