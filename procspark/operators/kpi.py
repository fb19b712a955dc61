"""Executive metrics. Every number is a partial aggregate; tables are reduced before they are combined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procspark.functions.values import agency_family, category_family, source_system


def _sum_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))


def one_row(*parts: DataFrame) -> DataFrame:
    """Join one-row aggregates side by side without a join: their columns are disjoint."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(0.0)


def roi_metrics(plans: DataFrame) -> DataFrame:
    done = plans.filter(F.col("status") == "COMPLETED")
    total, n = F.coalesce(F.sum("saved_cents"), F.lit(0)), F.count("saved_cents")
    return done.agg(F.count("*").alias("completed_action_plans"), (total / 100.0).alias("total_dollars_saved"),
                    F.when(n > 0, total / n / 100.0).otherwise(0.0).alias("average_dollars_saved"))


def coverage_metrics(df: DataFrame, cases: DataFrame, digits: int = 4) -> DataFrame:
    totals = df.agg(F.count("*").alias("total_transactions"))
    by_status = cases.agg(
        F.count("*").alias("audited_transactions"), _sum_if(F.col("status") == "OPEN").alias("open_cases"),
        _sum_if(F.col("status") == "IN_REVIEW").alias("in_review_cases"),
        _sum_if(F.col("status") == "CLOSED").alias("closed_cases"))
    return one_row(totals, by_status).withColumn(
        "audit_coverage_pct", percent(F.col("audited_transactions"), F.col("total_transactions"), digits))


def progress_metrics(df: DataFrame, cases: DataFrame) -> DataFrame:
    """How far scoring and auditing have come."""
    scored = df.agg(F.count("*").alias("total_transactions"), _sum_if(F.col("is_scored")).alias("scored_transactions"))
    both = one_row(scored, cases.agg(F.count("*").alias("audit_cases")))
    total = F.col("total_transactions")
    return both.withColumns({
        "unscored_transactions": total - F.col("scored_transactions"),
        "score_coverage_pct": percent(F.col("scored_transactions"), total, 2),
        "audit_coverage_pct": percent(F.col("audit_cases"), total, 4),
    })


def source_metrics(df: DataFrame, cases: DataFrame, limit: int | None = None, compat: bool = False) -> DataFrame:
    """Totals by source system, agency family and category family, the least covered first; all rows, or the first ``limit``."""
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be positive, not {limit}")
    c = cases.select("tx_id", F.lit(1).alias("has_case"), "risk_level", "escalated")
    rows = df.join(c, "tx_id", "left").groupBy(
        source_system(F.col("source")).alias("source_system"),
        agency_family(F.col("agency"), compat).alias("agency_family"),
        category_family(F.col("category"), compat).alias("category_family"),
    ).agg(
        F.count("*").alias("total_transactions"), _sum_if(F.col("is_scored")).alias("scored_transactions"),
        F.count("has_case").alias("audit_cases"), _sum_if(F.col("escalated")).alias("escalated_cases"),
        _sum_if(F.upper("risk_level") == "HIGH").alias("high_risk_cases"),
        F.round(F.coalesce(F.avg("ml_score"), F.lit(0.0)), 4).alias("avg_ml_score"),
    )
    dims = ["source_system", "agency_family", "category_family"]
    rows = rows.withColumn(
        "score_coverage_pct", percent(F.col("scored_transactions"), F.col("total_transactions"), 2)
    )
    order = ["score_coverage_pct", "total_transactions", *dims]
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def recent_cases(cases: DataFrame, n: int = 8) -> DataFrame:
    return cases.orderBy(F.desc("updated_at"), "case_id").limit(n)


def realtime_snapshot(df: DataFrame, cases: DataFrame, plans: DataFrame) -> DataFrame:
    """Coverage (two digits) and savings in one row; the latest cases are ``recent_cases``."""
    return one_row(coverage_metrics(df, cases, digits=2), roi_metrics(plans))


def recent_events(cases: DataFrame, plans: DataFrame, per_table: int = 8, n: int = 12) -> DataFrame:
    """The newest changes of cases and plans as events. Ranked rows only: two top-k, a union, a top-k."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    s = F.lit
    at = F.coalesce("updated_at", "created_at")
    top = lambda df, key: df.withColumn("event_at", at).filter(F.col("event_at").isNotNull()).orderBy(F.desc("event_at"), key).limit(per_table)
    a = top(cases, "case_id").select(
        F.concat(s("case:"), "case_id", s(":"), iso("event_at")).alias("id"), "event_at", s("CASE").alias("entity"),
        F.concat(s("Case "), F.substring("case_id", 1, 8), s(" updated")).alias("title"),
        F.concat(s("Risk="), F.coalesce("risk_level", s("UNKNOWN")), s(" · Status="), "status").alias("detail"),
        F.upper(F.coalesce("risk_level", s("LOW"))).alias("severity"))
    b = top(plans, "plan_id").select(
        F.concat(s("plan:"), "plan_id", s(":"), iso("event_at")).alias("id"), "event_at", s("ACTION_PLAN").alias("entity"),
        F.concat(s("Action plan "), F.substring("plan_id", 1, 8), s(" "), F.lower("status")).alias("title"),
        F.concat(s("Type="), "action_type", s(" · Owner="), "owner_email").alias("detail"),
        F.when(F.col("status") == "COMPLETED", "MEDIUM").otherwise("LOW").alias("severity"))
    return a.unionByName(b).orderBy(F.desc("event_at"), "id").limit(n)


def notifiable_events(events: DataFrame, seen: DataFrame, n: int = 3) -> DataFrame:
    fresh = events.filter(F.col("severity").isin("HIGH", "MEDIUM")).join(seen.select("id"), "id", "left_anti")
    return fresh.orderBy(F.desc("event_at"), "id").limit(n)
