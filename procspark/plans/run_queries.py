"""Registered queries: whole runs over the invoices - training, evaluation, orchestration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark.operators import augment, evaluate, forest, graph, models, rules
from procspark.operators import cases as C
from procspark.operators import features as feat
from procspark.operators import vendor_risk as vr
from procspark.plans.model_queries import CANDIDATES
from procspark.registry import query
from procspark.session import Hold, cut, scratch, shared_folder
from procspark.sources.tables import cases, spend

_trained: dict[tuple[str, str], str] = {}
KEYS = ["vendor_id", "tx_id", "ts", "cents", "agency"]


def _with_agency(made: DataFrame, real: DataFrame) -> DataFrame:
    """Made-up rows take their vendor's most frequent agency, of equals the first by name."""
    counts = real.filter("agency is not null").groupBy("vendor_id", "agency").agg(F.count("*").alias("n"))
    usual = counts.groupBy("vendor_id").agg(F.min_by("agency", F.struct(-F.col("n"), "agency")).alias("agency"))
    return made.join(usual, "vendor_id", "left")


def _with_labelled(spark: SparkSession, sf: str, seed: int, hold: Hold = cut) -> DataFrame:
    """Features of the invoices, their synthetic history and a labelled set; only the set has labels."""
    # read for the size, the vendors' medians, spreads and agencies, and the windows
    real = hold(spend(spark, sf, agency=True).select(*KEYS))
    history = real.unionByName(_with_agency(augment.augment_cap(real), real).select(*KEYS))
    extra = _with_agency(augment.inject_labeled_anomalies(real, seed=seed), real).select(*KEYS, "label", "anomaly_type")
    return feat.feature_matrix(history.unionByName(extra, allowMissingColumns=True), hold=hold)


def trained(spark: SparkSession, sf: str) -> models.Model:
    """The model of these tables: trained and saved once per session, then loaded."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _trained:
        with scratch(spark) as hold:
            rows = _with_labelled(spark, sf, 555, hold)
            model = models.train(rows.filter("label is null"), rows.filter("label is not null"), "tx_id", CANDIDATES)
        path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
        models.save(model, spark, path)
        _trained[key] = path
    return models.load(spark, _trained[key])


def _report(df: DataFrame, section: str, name: str, values: list[str]) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")).select("section", "name", "m.*")


@query("evaluation_run")
def _(spark, sf):
    """The saved model on a labelled set it has not seen: sweep, operating point, both areas, types, importance."""
    model = trained(spark, sf)
    with scratch(spark) as hold:
        unseen = cut(_with_labelled(spark, sf, 777, hold).filter("label is not null"))
    scored = cut(models.apply(unseen, model).withColumnRenamed("ml_score", "score").withColumn("type", F.col("anomaly_type")))
    sweep = cut(evaluate.threshold_sweep(scored))
    scaled = evaluate.apply_scale(unseen, model.scale)
    importance = evaluate.attribution_importance(forest.attributions(scaled, model.forest))
    whole = lambda df, name, value: df.select(F.lit("curve").alias("section"), F.lit(name).alias("name"), F.lit("value").alias("measure"), F.col(value).alias("value"))
    parts = [
        _report(sweep, "sweep", "threshold", ["precision", "recall", "f1"]),
        _report(evaluate.optimal_threshold(sweep), "operating_point", "threshold", ["precision", "recall", "f1"]),
        whole(evaluate.roc_auc(scored), "roc_auc", "roc_auc"), whole(evaluate.pr_auc(scored), "pr_auc", "pr_auc"),
        _report(evaluate.per_type_summary(scored), "type", "type", ["count", "detected", "recall", "mean_score", "max_score"]),
        _report(importance, "importance", "feature", ["mean_abs_impact"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unscored(spark: SparkSession, sf: str, rows: DataFrame, hold: Hold = cut) -> DataFrame:
    """All features of the unscored invoices; the scored ones count as history and as peers."""
    return feat.feature_matrix(rows.select(*KEYS, "is_scored"), count_on=spend(spark, sf), hold=hold).filter(~F.col("is_scored"))


@query("orchestration_run")
def _(spark, sf):
    """One run over all unscored invoices: features, both model stages, rules and risks, cases, budget, verdicts, counters."""
    invoices = spend(spark, sf, agency=True, category=True)
    model = trained(spark, sf)
    with scratch(spark) as hold:
        rows = hold(invoices.select(*KEYS, "is_scored"))  # read for the windows, the vendors' risks and the graph's
        todo = _unscored(spark, sf, rows, hold)
        scored, _ = rules.score_batch(models.apply(todo, model), vr.vendor_risk_profile(rows), graph.graph_risk_score(rows))
        none_type = "array<struct<feature: string, raw_value: double, impact: double>>"
        scored = scored.withColumns({"top_reason": F.concat_ws("; ", "triggered_rules"), "attributions": F.array().cast(none_type)})
        scored = hold(scored.select("tx_id", "ts", "cents", "anomaly_score", "is_anomaly", "top_reason", "attributions"))
        known = cases(spark, sf)
        stored = known.withColumns({"attributions": F.lit(None).cast(none_type), "impact_cents": F.col("cents"), "summary": F.lit(None).cast("string")})
        upserted = hold(C.case_upsert(scored, stored, "ANOMALIES_ONLY"))
        batch = upserted.join(scored.select("tx_id", "ts"), "tx_id").select("case_id", "ml_score", "ts")
        pending = known.select("case_id", "ml_score", "created_at")
        sent = cut(C.budget_select(batch, pending, budget=50, min_score=0.6))
        # triage verdicts come from outside; without them the guardrail decides which cases get a deep audit
        shown = sent.join(upserted.select("case_id", "tx_id", "summary"), "case_id").join(invoices.select("tx_id", "category", "description"), "tx_id")
        audited = C.escalation_guardrail(C.risk_signals(shown).withColumns(
            {"escalate": F.lit(False), "reason": F.lit(""), "risk_level": rules.risk_level(F.col("ml_score"))}))
        return cut(C.orchestration_summary(scored, upserted, audited))
