"""The fitted model as one thing: scale, forest with its offset, second stage; trained, saved, loaded, applied."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark.operators import classifier, evaluate, forest, rules
from procspark.operators.features import FEATURES
from procspark.session import cut

STAGE_ONE = "stage_one"
_SECOND = "tree int, feature array<int>, bin array<int>, cut array<double>, value array<double>"


@dataclass
class Model:
    scale: evaluate.Scale
    forest: forest.Forest
    second: classifier.Boosted | None = None
    contamination: float | None = None
    held_out_f1: float | None = None


def _first_stage(df: DataFrame, model: Model) -> DataFrame:
    """Add the forest's ``sample_score``; the features stay unscaled."""
    keep = df.columns
    scaled = evaluate.apply_scale(df.select("*", *[F.col(c).alias(f"raw_{c}") for c in FEATURES]), model.scale)
    scored = forest.sample_score(scaled, model.forest)
    return scored.select(*[F.col(f"raw_{c}").alias(c) if c in FEATURES else F.col(c) for c in keep], "sample_score")


def train(history: DataFrame, labelled: DataFrame | None, key: str, candidates: list[float], trees: int = forest.TREES,
          rounds: int = classifier.ROUNDS, seed: int = 42) -> Model:
    """``history``: feature rows without labels; ``labelled``: feature rows with ``label``, for the offset and the second stage. The history is read
    several times, for the scale, the trees and the scores, so it should be at hand (cut, held or a table).

    The offset is the quantile of the history's scores at the contamination that does best on the labelled rows, or the first
    candidate where there are none.
    """
    scale = evaluate.fit_scale(history, FEATURES)
    model = Model(scale, forest.fit(evaluate.apply_scale(history, scale), key, FEATURES, trees=trees, seed=seed))
    training = cut(_first_stage(history, model).select("sample_score"))
    model.contamination = candidates[0]
    if labelled is not None:
        known = cut(_first_stage(labelled, model))
        best = evaluate.tune_contamination(known, candidates, training).filter("is_best").first()
        model.contamination = best["contamination"]
    offset = evaluate.exact_quantiles(training, ["sample_score"], [model.contamination]).first()["value"]
    model.forest.offset = offset
    if labelled is not None:
        staged = known.withColumn(STAGE_ONE, rules.normalized_decision(F.col("sample_score") - F.lit(offset)))
        data, cols = cut(classifier.stratified_split(staged, key, seed=seed)), [STAGE_ONE, *FEATURES]
        model.second = classifier.fit(data.filter(~F.col("is_test")), cols, rounds=rounds, seed=seed, key=key)
        model.held_out_f1 = classifier.held_out_f1(classifier.probability(data.filter("is_test"), model.second, cols))
    return model


def apply(df: DataFrame, model: Model) -> DataFrame:
    """Add ``sample_score``, ``decision``, ``probability`` (null without a second stage) and the blended ``ml_score``."""
    first = _first_stage(df, model)
    staged = forest.decision(first, model.forest.offset).withColumn(STAGE_ONE, rules.normalized_decision(F.col("decision")))
    if model.second is None:
        staged = staged.withColumn("probability", F.lit(None).cast("double"))
    else:
        staged = classifier.probability(staged, model.second, [STAGE_ONE, *FEATURES])
    return staged.withColumn("ml_score", rules.two_stage_score(F.col("decision"), F.col("probability"))).drop(STAGE_ONE)


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Tables of the trees of both stages, the scale and the settings, under one folder."""
    spark.createDataFrame(model.forest.trees, forest._TREE).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame([(c, *v) for c, v in model.scale.items()], "feature string, median double, spread double").write.mode("overwrite").parquet(f"{path}/scale")
    second = model.second
    row = (model.forest.sample, float(model.forest.offset), model.contamination, second.cols if second else None, second.depth if second else None,
           model.held_out_f1, model.forest.cols)
    spark.createDataFrame([row], "sample int, offset double, contamination double, second array<string>, depth int, held_out_f1 double, cols array<string>").write.mode("overwrite").parquet(f"{path}/settings")
    if second is not None:
        numbered = [{"tree": i, **t} for i, t in enumerate(second.trees)]
        spark.createDataFrame(numbered, _SECOND).write.mode("overwrite").parquet(f"{path}/second")


def load(spark: SparkSession, path: str) -> Model:
    s = spark.read.parquet(f"{path}/settings").first()
    trees = sorted((r.asDict() for r in spark.read.parquet(f"{path}/trees").collect()), key=lambda r: r["tree"])
    scale = {r["feature"]: (r["median"], r["spread"]) for r in spark.read.parquet(f"{path}/scale").collect()}
    second = None
    if s["second"] is not None:
        rows = sorted((r.asDict() for r in spark.read.parquet(f"{path}/second").collect()), key=lambda r: r.pop("tree"))
        second = classifier.Boosted(rows, list(s["second"]), s["depth"])
    return Model(scale, forest.Forest(trees, s["sample"], list(s["cols"]), s["offset"]), second, s["contamination"], s["held_out_f1"])
