"""Deterministic fraud rules and the blended score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procspark.functions.money import APPROVAL_LIMITS, near_limit

# Rule name, weight; the order is the order of reporting.
RULES = [
    ("SPLIT_BILLING_BURST", 0.30),
    ("WEEKEND_HIGH_VALUE", 0.20),
    ("BURST_24H", 0.35),
    ("NEAR_APPROVAL_THRESHOLD", 0.30),
    ("LARGE_ROUND_NUMBER", 0.20),
    ("VELOCITY_7D_HIGH", 0.20),
    ("BURST_48H_HIGH_SPEND", 0.25),
]


def _dollars(c: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, digits))


def conditions() -> dict[str, Column]:
    """Rule name -> predicate over the feature columns."""
    base = F.greatest(F.col("vendor_avg_amount"), F.lit(1.0))
    return {
        "SPLIT_BILLING_BURST": F.col("consecutive_small_invoices") >= 3,
        "WEEKEND_HIGH_VALUE": (F.col("is_weekend_payment") == 1) & (F.col("amount_vs_vendor_avg") > 2.0),
        "BURST_24H": F.col("invoice_count_24h") > 3,
        "NEAR_APPROVAL_THRESHOLD": near_limit(F.col("cents")),
        "LARGE_ROUND_NUMBER": (F.col("is_round_amount") == 1) & (F.col("cents") >= 5_000_000),
        "VELOCITY_7D_HIGH": F.col("invoice_count_7d") > 5,
        "BURST_48H_HIGH_SPEND": (F.col("invoice_sum_48h") > base * 3.0) & (F.col("invoice_count_48h") >= 2),
    }


def _details() -> dict[str, Column]:
    """The texts shown to an auditor, one per rule."""
    amount = F.col("cents") / F.lit(100.0)
    base = F.greatest(F.col("vendor_avg_amount"), F.lit(1.0))
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    limit = F.lit(None).cast("double")
    for value in reversed(APPROVAL_LIMITS):
        limit = F.when((F.col("cents") >= value * 95) & (F.col("cents") < value * 100), float(value)).otherwise(limit)
    return {
        "SPLIT_BILLING_BURST": F.concat(whole("consecutive_small_invoices"), F.lit(
            " consecutive invoices below the $10,000 micro-purchase threshold — possible split billing")),
        "WEEKEND_HIGH_VALUE": F.concat(
            F.lit("Weekend payment of "), F.format_number("amount_vs_vendor_avg", 1), F.lit(
                "× vendor historical avg — high-value weekend transactions bypass normal approval chains")),
        "BURST_24H": F.concat(whole("invoice_count_24h"), F.lit(
            " invoices submitted within 24 hours — velocity burst typical of fraud before detection cutoff")),
        "NEAR_APPROVAL_THRESHOLD": F.concat(
            F.lit("Invoice amount "), _dollars(amount), F.lit(" is within 5% below the "), _dollars(limit, 0),
            F.lit(" federal approval threshold — possible threshold manipulation")),
        "LARGE_ROUND_NUMBER": F.concat(
            F.lit("Invoice of exactly "), _dollars(amount), F.lit(
                " — large round-number amounts suggest fictitious or pre-arranged invoices")),
        "VELOCITY_7D_HIGH": F.concat(whole("invoice_count_7d"), F.lit(
            " invoices in last 7 days — unusually high frequency for a single vendor in government procurement")),
        "BURST_48H_HIGH_SPEND": F.concat(
            F.lit("48-hour spending of "), _dollars(F.col("invoice_sum_48h")), F.lit(" is "),
            F.format_number(F.col("invoice_sum_48h") / base, 1), F.lit(
                "× vendor's typical invoice — concentrated short-window payment burst")),
    }


def rule_hit(name: str) -> Column:
    return conditions()[name]


def evaluate_rules(df: DataFrame) -> DataFrame:
    """Add ``rule_score``, ``triggered_rules`` (in rule order) and ``rule_details``.

    The score is summed in hundredths so that it is exact.
    """
    hits, texts = conditions(), _details()
    points = F.lit(0)
    for name, weight in RULES:
        points = points + F.when(hits[name], round(weight * 100)).otherwise(0)
    names = F.array(*[F.when(hits[name], F.lit(name)) for name, _ in RULES])
    entries = F.array(*[F.when(hits[name], F.struct(F.lit(name).alias("key"), texts[name].alias("value")))
                        for name, _ in RULES])
    return df.select(
        "*",
        (F.least(points, F.lit(100)) / F.lit(100.0)).alias("rule_score"),
        F.filter(names, lambda x: x.isNotNull()).alias("triggered_rules"),
        F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())).alias("rule_details"),
    )


# ---------------------------------------------------------------------------------------------
# scores

UNKNOWN_VENDOR_RISK = 0.10
UNKNOWN_GRAPH_RISK = 0.05
ANOMALY_THRESHOLD = 0.5


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def normalized_decision(decision: Column) -> Column:
    """Forest decision value to [0, 1], 1 = most anomalous."""
    return unit(F.lit(0.5) - decision)


def two_stage_score(decision: Column, probability: Column | None = None) -> Column:
    base = normalized_decision(decision)
    if probability is None:
        return base
    return F.when(probability.isNull(), base).otherwise(unit(base * 0.4 + probability * 0.6))


def blend_score(df: DataFrame, vendor_risk: DataFrame, graph_risk: DataFrame,
                threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Add the four-part score. Both risk tables hold one row per vendor.

    The vendor join is the one place where a hot vendor meets a table as large as the vendors; the
    side has unique keys, so skewed partitions of the rows are split at run time without copies.
    """
    risk = vendor_risk.select("vendor_id", F.col("vendor_risk_score").alias("v_risk")).join(
        graph_risk.select("vendor_id", F.col("graph_risk_score").alias("g_risk")), "vendor_id", "full")
    joined = df.join(risk, "vendor_id", "left")
    v = F.coalesce("v_risk", F.lit(UNKNOWN_VENDOR_RISK))
    g = F.coalesce("g_risk", F.lit(UNKNOWN_GRAPH_RISK))
    score = unit(F.col("ml_score") * 0.50 + F.col("rule_score") * 0.25 + v * 0.15 + g * 0.10)
    return joined.select(*df.columns, v.alias("vendor_risk_score"), g.alias("graph_risk_score"),
                         score.alias("anomaly_score"), (score >= threshold).alias("is_anomaly"))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.80, "HIGH").when(score >= 0.60, "MEDIUM").otherwise("LOW")


def _messages(raw: Column, amount: Column, impact: Column) -> dict[str, Column]:
    """One sentence per feature."""
    word = F.when(impact > 0, "elevated").otherwise("suppressed")
    whole = raw.cast("bigint").cast("string")
    usd = lambda c: _dollars(c)
    s = F.lit
    return {
        "amount_log": F.concat(s("Transaction amount "), usd(amount), s(" is unusually "), word),
        "vendor_30d_velocity": F.concat(s("Vendor 30-day spend velocity is "), word, s(" ("), usd(raw), s(" in window)")),
        "days_since_last_invoice": F.concat(
            s("Gap since last invoice ("), F.format_number(raw, 1), s(" days) is anomalous for this vendor")),
        "is_weekend_payment": s("Payment issued on a weekend — unusual in standard procurement cycles"),
        "amount_vs_vendor_avg": F.concat(s("Amount is "), F.format_number(raw, 2), s("× this vendor's historical average")),
        "invoice_count_7d": F.concat(s("Vendor submitted "), whole, s(" invoice(s) in the last 7 days (velocity burst)")),
        "invoice_count_30d": F.concat(s("Vendor submitted "), whole, s(" invoice(s) in the last 30 days (elevated volume)")),
        "rolling_7d_sum": F.concat(s("Vendor's 7-day rolling spend is "), usd(raw), s(" (unusual short-window burst)")),
        "max_invoices_7d_window": F.concat(s("Historical burst rate ("), whole, s(" invoices/7-day window) is anomalous")),
        "consecutive_small_invoices": F.concat(whole, s(" consecutive invoices under the $10k split-billing threshold")),
        "amount_std_30d": F.concat(s("Amount variability in last 30 days (std="), usd(raw), s(") is abnormal")),
        "is_round_amount": F.concat(s("Transaction amount "), usd(amount), s(" is a suspicious round number")),
        "invoice_count_24h": F.concat(whole, s(" invoice(s) submitted within the last 24 hours — extreme velocity burst")),
        "invoice_count_48h": F.concat(whole, s(" invoice(s) submitted within the last 48 hours — rush billing pattern")),
        "invoice_sum_48h": F.concat(s("48-hour spend total "), usd(raw), s(" — concentrated short-window payment burst")),
        "approval_limit_proximity": F.concat(
            s("Amount "), usd(amount), s(" is within 5% below a federal approval threshold (threshold manipulation)")),
    }


def top_reason(df: DataFrame) -> DataFrame:
    """Add the sentence for the attribution with the largest absolute impact, rules first.

    Needs ``attributions`` (array of feature, raw_value, impact), ``triggered_rules`` and ``cents``.
    Equal impacts keep the order of the array.
    """
    ranked = F.transform("attributions", lambda a, i: F.struct(
        F.abs(a["impact"]).alias("size"), (-i).alias("at"), a.alias("a")))
    top = df.withColumn("top", F.array_max(ranked)["a"])
    feature, raw, impact = F.col("top.feature"), F.col("top.raw_value"), F.col("top.impact")
    text = F.concat(F.lit("Feature '"), feature, F.lit("' is anomalous (shap="), F.format_number(impact, 4), F.lit(")"))
    for name, sentence in _messages(raw, F.col("cents") / F.lit(100.0), impact).items():
        text = F.when(feature == name, sentence).otherwise(text)
    prefix = F.when(F.size("triggered_rules") > 0, F.concat(
        F.lit("[Rules: "), F.concat_ws("; ", "triggered_rules"), F.lit("] "))).otherwise(F.lit(""))
    return top.select(*df.columns, F.concat(prefix, text).alias("top_reason"))


def score_batch(df: DataFrame, vendor_risk: DataFrame, graph_risk: DataFrame,
                threshold: float = ANOMALY_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Score every valid row; rows without vendor, time or a non-negative amount come back apart."""
    valid = (F.col("vendor_id").isNotNull() & F.col("ts").isNotNull()
             & F.coalesce(F.col("cents") >= 0, F.lit(False)))
    scored = blend_score(evaluate_rules(df.filter(valid)), vendor_risk, graph_risk, threshold)
    return scored, df.filter(~valid)
