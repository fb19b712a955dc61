"""Audit cases: selection, upsert, triage signals, verdicts, plans, listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procspark.operators.rules import risk_level
from procspark.operators.upserts import upsert_latest

# Triage keywords in reporting order, escalation limits, payload sizes.
KEYWORDS = [
    "split", "split invoice", "split billing", "threshold", "round-number", "weekend", "burst", "duplicate",
    "backdated", "rapid", "cluster", "near approval", "sequential", "same-day",
]
HARD_SCORE, SOFT_SCORE, SOFT_HITS = 0.80, 0.60, 2
REASON_CHARS, TRIAGE_CHARS, AUDIT_CHARS, CLAUSE_CHARS, MAX_CLAUSES = 800, 3500, 5000, 850, 2
VERDICTS = ["FRAUD", "SUSPICIOUS", "NORMAL", "INCONCLUSIVE"]


def unscored_batch(df: DataFrame, n: int) -> DataFrame:
    return df.filter(~F.col("is_scored")).orderBy(F.desc("ts"), "tx_id").limit(n)


def case_upsert(scored: DataFrame, cases: DataFrame, policy: str = "ALL_SCORED") -> DataFrame:
    """One outer join on the transaction: refresh known cases, open missing ones as the policy says.

    ``scored`` carries tx_id, cents, anomaly_score, is_anomaly, top_reason and attributions; the result
    tells by ``action`` what happened to each case.
    """
    opens = F.lit(True) if policy == "ALL_SCORED" else F.col("s.is_anomaly")
    s = scored.select("tx_id", F.struct("anomaly_score", "is_anomaly", "top_reason", "cents",
                                        F.slice("attributions", 1, 5).alias("attributions")).alias("s"))
    joined = cases.withColumn("known", F.lit(True)).join(s, "tx_id", "full")
    known, hit = F.col("known").isNotNull(), F.col("s").isNotNull()
    kept = joined.filter(known | opens)
    pick = lambda new, old: F.when(hit, new).otherwise(old)
    return kept.select(
        F.coalesce("case_id", F.concat(F.lit("case-"), "tx_id")).alias("case_id"), "tx_id",
        pick(F.col("s.anomaly_score"), F.col("ml_score")).alias("ml_score"),
        pick(F.col("s.top_reason"), F.col("summary")).alias("summary"),
        pick(F.col("s.attributions"), F.lit(None)).alias("attributions"),
        F.coalesce("status", F.lit("OPEN")).alias("status"),
        pick(risk_level(F.col("s.anomaly_score")), F.col("risk_level")).alias("risk_level"),
        pick(F.col("s.cents"), F.col("impact_cents")).alias("impact_cents"),
        F.when(~hit, "kept").when(known, "updated").otherwise("created").alias("action"),
    )


def orchestration_summary(scored: DataFrame, upserted: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Counters of one run. The inputs are reduced apart and added up, which needs no join.

    ``verdicts``: one row per case that was sent to triage, with ``escalate``; an escalated one had its deep audit.
    """
    flag = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    level = risk_level(F.col("anomaly_score"))
    a = scored.agg(F.count("*").alias("scanned"), F.count("anomaly_score").alias("scored"),
                   flag(level == "HIGH").alias("high_risk"), flag(level == "MEDIUM").alias("medium_risk"),
                   flag(level == "LOW").alias("low_risk"))
    b = upserted.agg(flag(F.col("action") == "created").alias("cases_created"),
                     flag(F.col("action") == "updated").alias("cases_updated"))
    both = a.unionByName(b, allowMissingColumns=True)
    if verdicts is not None:
        both = both.unionByName(verdicts.agg(F.count("*").alias("llm_triaged"), flag(F.col("escalate")).alias("llm_deep_audited")), allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])


# ---------------------------------------------------------------------------------------------
# triage and verdicts


def risk_signals(df: DataFrame) -> DataFrame:
    """Keywords found in description, category and summary: all are counted, the first six are kept."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("description", "category", "summary")]))
    hits = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(text, k))
    return df.withColumn("signals", hits).withColumns(
        {"signal_hits": F.size("signals"), "keywords": F.slice("signals", 1, 6)}).drop("signals")


def escalation_guardrail(df: DataFrame) -> DataFrame:
    """Overrule a model verdict (escalate, reason, risk_level) that did not escalate a clear case."""
    score = F.coalesce("ml_score", F.lit(0.0))
    hard = score >= HARD_SCORE
    soft = (score >= SOFT_SCORE) & (F.col("signal_hits") >= SOFT_HITS)
    applied = ~F.col("escalate") & (hard | soft)
    prefix = F.concat(F.lit("Escalation guardrail applied by policy (ml_score="), F.format_number(score, 3),
                      F.lit(", signal_hits="), F.col("signal_hits"), F.lit(")."))
    reason = F.substring(F.trim(F.concat(prefix, F.lit(" "), "reason")), 1, REASON_CHARS)
    return df.withColumns({
        "risk_level": F.when(applied, F.when(hard, "HIGH").otherwise("MEDIUM")).otherwise(F.col("risk_level")),
        "reason": F.when(applied, reason).otherwise(F.col("reason")),
        "escalate": F.col("escalate") | applied,
    })


TX_FIELDS = ["transaction_id", "vendor_id", "amount", "date", "category", "description", "awarding_agency", "ml_score",
             "shap_summary"]


def _tx_struct() -> Column:
    return F.struct(*TX_FIELDS)


def _json(fields: Column) -> Column:
    return F.to_json(fields, {"ignoreNullFields": "false"})


def _shorter(text: Column, by: Column) -> Column:
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - by, F.lit(0)))


def _within(df: DataFrame, limit: int, build: Callable[[Column], Column]) -> DataFrame:
    """``payload`` of at most ``limit`` characters: values are shortened before they become JSON, which stays whole.

    ``build(n)`` gives the text with its long values shortened by ``n`` characters each.
    """
    full = df.withColumn("payload", build(F.lit(0)))
    over = F.greatest(F.length("payload") - limit, F.lit(0))
    return full.withColumn("payload", F.when(over == 0, F.col("payload")).otherwise(build(over)))


def triage_payload(df: DataFrame, chars: int = TRIAGE_CHARS) -> DataFrame:
    """The compact nine fields and the signals as JSON text; summary, description give way to the limit."""

    def build(n: Column) -> Column:
        long = {"shap_summary", "description"}
        tx = [_shorter(F.col(c).cast("string"), n).alias(c) if c in long else F.col(c) for c in TX_FIELDS]
        return _json(F.struct(*tx, F.struct("ml_score", "signal_hits", "keywords").alias("risk_signals")))

    return _within(df, chars, build)


def audit_payload(df: DataFrame, chars: int = AUDIT_CHARS, clause_chars: int = CLAUSE_CHARS, max_clauses: int = MAX_CLAUSES) -> DataFrame:
    """Transaction and its first clauses (column ``hits``: contract_id, score, text) as JSON text; clause texts, summary and
    description give way to the limit."""
    clauses = F.transform(F.slice("hits", 1, max_clauses), lambda h: F.struct(
        h["contract_id"].alias("contract_id"), h["score"].alias("score"),
        F.substring(h["text"], 1, clause_chars).alias("text")))

    def build(n: Column) -> Column:
        long = {"shap_summary", "description"}
        tx = F.struct(*[_shorter(F.col(c).cast("string"), n).alias(c) if c in long else F.col(c) for c in TX_FIELDS])
        short = F.transform("clauses", lambda h: F.struct(h["contract_id"].alias("contract_id"), h["score"].alias("score"), _shorter(h["text"], n).alias("text")))
        return _json(F.struct(tx.alias("transaction"), short.alias("clauses")))

    return _within(df.withColumn("clauses", clauses), chars, build)


REPORT = "struct<verdict: string, violated_clause: string, confidence: double, rationale: string, cited_clause_text: string>"


def verdict_validation(df: DataFrame, col: str = "report") -> tuple[DataFrame, DataFrame]:
    """Parsed reports that keep to the schema, and apart from them those that do not."""
    rows = df.withColumn("r", F.from_json(col, REPORT))
    r = lambda f: F.col("r")[f]
    length = lambda c, n: c.isNull() | (F.length(c) <= n)
    ok = F.coalesce(
        r("verdict").isin(*VERDICTS) & r("confidence").between(0.0, 1.0) & F.length(r("rationale")).between(8, 1200)
        & length(r("violated_clause"), 150) & length(r("cited_clause_text"), 4000), F.lit(False))
    rest = [c for c in df.columns if c != col]
    return rows.filter(ok).select(*rest, "r.*"), rows.filter(~ok).drop("r")


def apply_verdicts(cases: DataFrame, triage: DataFrame, reports: DataFrame) -> DataFrame:
    """Write triage and report of each case; a case that was not escalated becomes inconclusive.

    An escalated case without a valid report keeps what it had.
    """
    t = triage.select("case_id", F.struct("escalate", "risk_level").alias("t"))
    r = reports.select("case_id", F.struct("verdict", "confidence", "violated_clause", "cited_clause_text").alias("r"))
    joined = cases.join(t, "case_id", "left").join(r, "case_id", "left")
    calm = F.coalesce(~F.col("t.escalate"), F.lit(False))
    told = F.coalesce(F.col("t.escalate"), F.lit(False)) & F.col("r").isNotNull()
    pick = lambda new, old: F.when(told, new).when(~calm, old)
    changed = {
        "escalated": F.coalesce("t.escalate", "escalated"),
        "risk_level": F.coalesce("t.risk_level", "risk_level"),
        "verdict": F.when(calm, "INCONCLUSIVE").when(told, F.col("r.verdict")).otherwise(F.col("verdict")),
        "confidence": pick(F.col("r.confidence"), F.col("confidence")),
        "violated_clause": pick(F.col("r.violated_clause"), F.col("violated_clause")),
        "cited_clause_text": pick(F.col("r.cited_clause_text"), F.col("cited_clause_text")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in cases.columns])


def budget_select(batch: DataFrame, pending: DataFrame, budget: int, min_score: float) -> DataFrame:
    """Cases to send to the models: those of the batch newest first, then the newest pending ones.

    A pending case below the minimum uses its place without being sent. Both parts are cut to the budget
    before they meet, so the ranking holds at most twice the budget.
    """
    first = batch.filter(F.col("ml_score") >= min_score).select(
        "case_id", "ml_score", F.lit(0).alias("turn"), F.col("ts").alias("at")).orderBy(F.desc("at"), "case_id").limit(budget)
    rest = pending.join(batch.select("case_id"), "case_id", "left_anti").select(
        "case_id", "ml_score", F.lit(1).alias("turn"), F.col("created_at").alias("at")).orderBy(
        F.desc("at"), "case_id").limit(budget)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("turn", F.desc("at"), "case_id"))
    return first.unionByName(rest).withColumn("rank", rank).filter(
        (F.col("rank") <= budget) & (F.col("ml_score") >= min_score))


# ---------------------------------------------------------------------------------------------
# listings and updates


def page_of(df: DataFrame, key: str, page: int, size: int, newest: str = "created_at") -> DataFrame:
    """One page, newest first. ``limit`` keeps this a top-k per partition; only the page leaves the tasks."""
    return df.orderBy(F.desc(newest), key).offset((page - 1) * size).limit(size)


def list_cases(cases: DataFrame, status: str | None = None, verdict: str | None = None, risk: str | None = None,
               min_score: float | None = None) -> DataFrame:
    """The filtered cases; page them with ``page_of``, count them with ``count``."""
    out = cases
    if status:
        out = out.filter(F.col("status") == status)
    if verdict:
        out = out.filter(F.col("verdict") == verdict)
    if risk:
        out = out.filter(F.col("risk_level") == risk.upper())
    if min_score is not None:
        out = out.filter(F.col("ml_score") >= min_score)
    return out


def case_detail(cases: DataFrame, case_id: str) -> DataFrame:
    return cases.filter(F.col("case_id") == case_id)


def update_cases(cases: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """Status and notes changes as an upsert; changes to unknown cases are dropped."""
    known = changes.join(cases.select("case_id"), "case_id", "left_semi")
    return upsert_latest(cases, known, "case_id", order)


def create_action_plan(plans: DataFrame, requests: DataFrame, cases: DataFrame) -> DataFrame:
    """Append pending plans of requests whose case exists."""
    new = requests.join(cases.select("case_id"), "case_id", "left_semi").withColumn("status", F.lit("PENDING"))
    return plans.unionByName(new, allowMissingColumns=True)


def action_plan_status_update(plans: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Set status and notes; completion is stamped; savings change only when given."""
    c = changes.select("plan_id", F.struct("status", "notes", "saved_cents").alias("c"))
    joined = plans.join(c, "plan_id", "left")
    hit = F.col("c").isNotNull()
    changed = {
        "status": F.when(hit, F.col("c.status")).otherwise(F.col("status")),
        "notes": F.when(hit, F.col("c.notes")).otherwise(F.col("notes")),
        "saved_cents": F.coalesce("c.saved_cents", "saved_cents"),
        "completed_at": F.when(F.col("c.status") == "COMPLETED", now).otherwise(F.col("completed_at")),
    }
    return joined.select(*[changed[n].alias(n) if n in changed else F.col(n) for n in plans.columns])


def list_action_plans(plans: DataFrame, status: str | None = None, owner: str | None = None,
                      case_id: str | None = None) -> DataFrame:
    out = plans
    for col, value in (("status", status), ("owner_email", owner), ("case_id", case_id)):
        if value is not None:
            out = out.filter(F.col(col) == value)
    return out


def top_risk_cases(cases: DataFrame, n: int = 5) -> DataFrame:
    wanted = (F.col("risk_level") == "HIGH") | F.coalesce("escalated", F.lit(False))
    return cases.filter(wanted).orderBy(F.desc("created_at"), "case_id").limit(n)


def risk_mix(cases: DataFrame) -> DataFrame:
    """Cases by level; anything but HIGH and MEDIUM counts as low."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    level = F.coalesce("risk_level", F.lit("LOW"))
    return cases.agg(n(level == "HIGH").alias("high"), n(level == "MEDIUM").alias("medium"),
                     n(~level.isin("HIGH", "MEDIUM")).alias("low"))
