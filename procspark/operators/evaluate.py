"""Evaluation of scores against labels carried in the same row (``score``, ``label`` 0/1, optional ``type``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procspark.operators.scan import running_sums

# The sweep and the precision an operating point should keep.
THRESHOLDS = [0.1 + 0.05 * i for i in range(18)]
PRECISION_FLOOR = 0.60


def _outcomes(hits: Column, flagged: Column, positives: Column, digits: int | None = 3) -> list[Column]:
    """Precision, recall, F1; with nothing flagged (1, 0, 0). ``digits``: places shown, all if none."""
    p = F.when(flagged == 0, 1.0).otherwise(hits / flagged)
    r = F.when((flagged == 0) | (positives == 0), 0.0).otherwise(hits / positives)
    f = F.when((flagged == 0) | (hits == 0), 0.0).otherwise(2.0 * hits / (flagged + positives))
    shown = lambda c: c if digits is None else F.round(c, digits)
    return [shown(p).alias("precision"), shown(r).alias("recall"), shown(f).alias("f1")]


def threshold_sweep(df: DataFrame, keys: list[str] = (), digits: int | None = 3) -> DataFrame:
    """One row per threshold. Each row falls into one of 19 buckets, so a single aggregate sees the data once;
    what remains is arithmetic on 19 counts."""
    bucket = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in THRESHOLDS), F.lit(0))
    counts = df.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    above = lambda c, i: F.coalesce(F.sum(F.when(F.col("bucket") > i, F.col(c))), F.lit(0))
    rows = F.array(*[F.struct(F.lit(round(t, 2)).alias("threshold"), above("n", i).alias("flagged"), above("pos", i).alias("hits"))
                     for i, t in enumerate(THRESHOLDS)])
    wide = counts.groupBy(*keys).agg(F.sum("pos").alias("positives"), rows.alias("rows"))
    return wide.select(*keys, "positives", F.inline("rows")).select(
        *keys, "threshold", *_outcomes(F.col("hits"), F.col("flagged"), F.col("positives"), digits))


def optimal_threshold(sweep: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Best F1 among thresholds with enough precision, else best F1 of all; the lowest threshold wins ties."""
    rank = F.struct((F.col("precision") >= PRECISION_FLOOR).alias("ok"), "f1", (-F.col("threshold")).alias("t"))
    return sweep.groupBy(*keys).agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), rank).alias("r")).select(*keys, "r.*")


def _by_score(df: DataFrame) -> DataFrame:
    """One row per distinct score: equal scores form one step of both curves."""
    return df.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"),
                                   F.sum(1 - F.col("label").cast("long")).alias("neg"))


def roc_auc(df: DataFrame, n_slices: int | None = None) -> DataFrame:
    """Mann-Whitney with half credit for ties. The ranking is a sliced running sum, never one sorted task."""
    steps = running_sums(_by_score(df), [], ["score"], ["neg"], n_slices)
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return steps.agg(F.when(pairs > 0, won / pairs).otherwise(0.0).alias("roc_auc"))


def pr_auc(df: DataFrame, n_slices: int | None = None) -> DataFrame:
    """Trapezoids under the precision-recall curve from the highest score down, starting at (0, 1)."""
    steps = _by_score(df).withColumn("down", -F.col("score"))
    steps = running_sums(steps, [], ["down"], ["pos", "neg"], n_slices)
    tp0, fp0 = F.col("pos_before"), F.col("neg_before")
    tp1, fp1 = tp0 + F.col("pos"), fp0 + F.col("neg")
    before = F.when(tp0 + fp0 == 0, 1.0).otherwise(tp0 / (tp0 + fp0))
    area = F.sum(F.col("pos") * (before + tp1 / (tp1 + fp1)) / 2.0)
    total = F.sum("pos")
    return steps.agg(F.when(total > 0, area / total).otherwise(0.0).alias("pr_auc"))


def per_type_summary(df: DataFrame) -> DataFrame:
    """Count, detection at one half, mean and highest score of the anomalies of each type."""
    hit = F.col("label") == 1
    found = F.sum(F.when(hit & (F.col("score") >= 0.5), 1).otherwise(0))
    return df.groupBy("type").agg(
        F.count("*").alias("count"), found.alias("detected"), F.round(found / F.count("*"), 3).alias("recall"),
        F.round(F.coalesce(F.avg(F.when(hit, F.col("score"))), F.avg("score")), 4).alias("mean_score"),
        F.round(F.max(F.when(hit, F.col("score"))), 4).alias("max_score"))


def attribution_importance(df: DataFrame) -> DataFrame:
    """Mean absolute impact per feature over all rows with ``attributions``."""
    return df.select(F.explode("attributions").alias("a")).groupBy(F.col("a.feature").alias("feature")).agg(
        F.avg(F.abs("a.impact")).alias("mean_abs_impact"))


def tune_contamination(scores: DataFrame, candidates: list[float], training: DataFrame | None = None) -> DataFrame:
    """Best threshold of every contamination candidate from raw forest scores (``sample_score``, ``label``), and which candidate wins.

    The contamination only moves the offset, the exact quantile of the training rows' scores, so one fitted forest serves all
    candidates. Thresholds compete by unrounded F1, candidates by F1 to four digits; the first of equals wins.
    """
    found = exact_quantiles(scores if training is None else training, ["sample_score"], candidates)
    offsets = {r["prob"]: r["value"] for r in found.collect()}  # one number per candidate
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("contamination"), F.lit(offsets[c]).alias("offset")) for c in candidates]))
    rows = scores.select("label", "sample_score", pairs.alias("c")).select(
        "label", "c.contamination", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - (F.col("sample_score") - F.col("c.offset")))).alias("score"))
    sweep = threshold_sweep(rows, ["contamination"], digits=None)
    rank = F.struct("f1", (-F.col("threshold")).alias("t"))
    best = sweep.groupBy("contamination").agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), rank).alias("r"))
    place = F.map_from_arrays(F.array(*[F.lit(c) for c in candidates]), F.array(*[F.lit(-i) for i in range(len(candidates))]))
    shown = best.select("contamination", "r.threshold", *[F.round(f"r.{c}", 4).alias(c) for c in ("precision", "recall", "f1")])
    top = Window.partitionBy(F.lit(0))  # as many rows as there are candidates
    order = F.struct("f1", F.element_at(place, F.col("contamination")).alias("p"))
    return shown.withColumn("is_best", F.max(order).over(top)["p"] == F.element_at(place, F.col("contamination")))


SKETCH = 2_000  # a sketch's rank is off by at most a row in so many


def _numbers(df: DataFrame, cols: list[str], kept: list[Column] | None = None) -> DataFrame:
    """``feature, value``: the numbers of the columns one below the other, without nulls, or those of them that ``kept`` takes."""
    item = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
    items = [item(c) if kept is None else F.when(k, item(c)) for c, k in zip(cols, kept or cols)]
    return df.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull() & x["value"].isNotNull())).alias("x")).select("x.*")


def _between(df: DataFrame, cols: list[str], probs: list[float], slack: float) -> list[list[tuple]]:
    """Per column and probability, two values between which the quantile should lie, from one pass of sketches; none for an open end."""
    ends = [p + side * slack for p in probs for side in (-1, 1)]
    asked = [min(1.0, max(0.0, p)) for p in ends]
    # NaN lies above all numbers; a sketch takes it as infinite
    finite = lambda c: F.when(F.isnan(F.col(c).cast("double")), float("inf")).otherwise(F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(finite(c), asked, SKETCH).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i in range(len(cols)):
        at = [v if 0 < p < 1 else None for v, p in zip(row[i] or [None] * len(ends), ends)]
        out.append([(at[2 * j], at[2 * j + 1]) for j in range(len(probs))])
    return out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], n_slices: int | None = None) -> DataFrame:
    """``feature, prob, value`` with linear interpolation, exact; the rows are read three times and few of them are moved.

    Sketches tell two values between which a quantile lies. A count of the numbers up to these values says whether it does, and between which ranks; an
    end that does not hold is left open. Only numbers between the ends are ranked, equal ones counted together before they move.
    """
    ends = _between(df, cols, probs, 2.0 / SKETCH)
    value = lambda c: F.col(c).cast("double")
    counts = [F.count(value(c)).alias(f"n{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(cols):
        for j, (low, high) in enumerate(ends[i]):
            counts += [F.count_if(value(c) < F.lit(low)).alias(f"b{i}_{j}")] if low is not None else []
            counts += [F.count_if(value(c) <= F.lit(high)).alias(f"u{i}_{j}")] if high is not None else []
    row = df.agg(*counts).first().asDict()
    wanted, kept = [], []
    for i, c in enumerate(cols):
        some = F.lit(False)
        for j, p in enumerate(probs if row[f"n{i}"] else []):
            at = (row[f"n{i}"] - 1) * p
            low, high = ends[i][j]
            before = row.get(f"b{i}_{j}", 0)
            if low is None or before > math.floor(at):
                low, before = None, 0
            if high is None or row[f"u{i}_{j}"] <= math.ceil(at):
                high = None
            part = F.lit(True) if low is None else value(c) >= F.lit(low)
            some = some | (part if high is None else part & (value(c) <= F.lit(high)))
            wanted.append((c, p, low, high, math.floor(at) - before, math.ceil(at) - before, at - math.floor(at)))
        kept.append(some)
    spark = df.sparkSession
    places = spark.createDataFrame(wanted, "feature string, prob double, from double, to double, low bigint, high bigint, part double")
    counted = _numbers(df, cols, kept).groupBy("feature", "value").agg(F.count("*").alias("n"))
    # a handful of wanted positions per feature: their number is fixed by the arguments
    inside = (F.col("from").isNull() | (F.col("value") >= F.col("from"))) & (F.col("to").isNull() | (F.col("value") <= F.col("to")))
    near = counted.join(F.broadcast(places), "feature").filter(inside)
    hits = running_sums(near, ["feature", "prob"], ["value"], ["n"], n_slices)
    holds = lambda k: (F.col(k) >= F.col("n_before")) & (F.col(k) < F.col("n_before") + F.col("n"))
    return hits.filter(holds("low") | holds("high")).groupBy("feature", "prob").agg(
        F.max(F.when(holds("low"), F.col("value"))).alias("a"), F.max(F.when(holds("high"), F.col("value"))).alias("b"),
        F.first("part").alias("part")).select("feature", "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


Scale = dict[str, tuple[float, float]]


def fit_scale(df: DataFrame, cols: list[str], n_slices: int | None = None) -> Scale:
    """Median and spread (q90 - q10; zero becomes one) of every column: three numbers per column come to the driver."""
    stats = {(r["feature"], r["prob"]): r["value"] for r in exact_quantiles(df, cols, [0.1, 0.5, 0.9], n_slices).collect()}
    return {c: (stats[c, 0.5], (stats[c, 0.9] - stats[c, 0.1]) or 1.0) for c in cols}


def apply_scale(df: DataFrame, scale: Scale) -> DataFrame:
    moved = lambda c: ((F.col(c) - F.lit(scale[c][0])) / F.lit(scale[c][1])).alias(c)
    return df.select(*[moved(c) if c in scale else F.col(c) for c in df.columns])


def robust_scale(df: DataFrame, cols: list[str], n_slices: int | None = None) -> DataFrame:
    """(x - median) / (q90 - q10); a spread of zero divides by one."""
    return apply_scale(df, fit_scale(df, cols, n_slices))
