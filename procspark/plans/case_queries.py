"""Registered queries: scoring on given model outputs, cases, verdicts, plans, metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark.operators import cases as C
from procspark.operators import features as feat
from procspark.operators import graph, kpi, paging, rules
from procspark.operators import vendor_risk as vr
from procspark.plans.audit_queries import KEYS, RISK_SQL, RULE_SQL, SPEND_TEMPORAL
from procspark.plans.graph_queries import GRAPH_RISK_CTES
from procspark.plans.ingest_queries import DIMS_SQL, agency_text, category_text
from procspark.operators.scan import running_sums
from procspark.registry import query
from procspark.session import cut, shared_folder
from procspark.sources.tables import CASES_SQL, PLANS_SQL, SPEND_SQL, cases, plans, spend

WITH_CASES = "WITH " + CASES_SQL
WITH_PLANS = "WITH " + PLANS_SQL
WITH_BOTH = "WITH " + CASES_SQL + "," + PLANS_SQL

# ---------------------------------------------------------------------------------------------
# scores, given model outputs: decision and probability are arithmetic on the keys of the line

MODEL_SQL = """((l_orderkey * 13 + l_partkey * 7 + l_linenumber) % 1000) / 1000.0 - 0.4 AS decision,
  CASE WHEN l_linenumber <> 4 THEN ((l_orderkey * 31 + l_partkey) % 1000) / 1000.0 END AS probability"""


def decision() -> Column:
    return ((F.col("l_orderkey") * 13 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % 1000) / F.lit(1000.0) - 0.4


def probability() -> Column:
    return F.when(F.col("l_linenumber") != 4, ((F.col("l_orderkey") * 31 + F.col("l_partkey")) % 1000) / F.lit(1000.0))


TWO_STAGE = """greatest(0.0, least(1.0, CASE WHEN probability IS NULL THEN greatest(0.0, least(1.0, 0.5 - decision))
  ELSE 0.4 * greatest(0.0, least(1.0, 0.5 - decision)) + 0.6 * probability END))"""


@query("two_stage_ml_score", "WITH " + """m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, """ + MODEL_SQL + """ FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(""" + TWO_STAGE + """, 6) AS ml_score FROM m""")
def _(spark, sf):
    return spend(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("vendor_id").alias("l_suppkey"),
        F.round(rules.two_stage_score(decision(), probability()), 6).alias("ml_score"))


@query("risk_level", WITH_CASES + " SELECT tx_id, ml_score, risk_level AS level FROM cases")
def _(spark, sf):
    df = spend(spark, sf, order=True).filter(F.col("ml_score") >= 0.4)
    return df.select("tx_id", "ml_score", rules.risk_level(F.col("ml_score")).alias("level"))


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices with their features and the given model score."""
    rows = spend(spark, sf, agency=True)
    ml = F.round(rules.two_stage_score(decision(), probability()), 6)
    keyed = rows.select(*KEYS, ml.alias("ml_score"))
    return feat.temporal_features(keyed, count_on=spend(spark, sf))


BLEND_SQL = SPEND_TEMPORAL + RULE_SQL + "," + RISK_SQL.format(src="spend") + "," + GRAPH_RISK_CTES + """,
ml AS (SELECT tx_id, round(""" + TWO_STAGE + """, 6) AS ml_score FROM (SELECT *, """ + MODEL_SQL + """ FROM (SELECT tx_id, l_orderkey, l_linenumber, l_partkey FROM spend))),
blended AS (
  SELECT r.*, ml.ml_score, coalesce(p.vendor_risk_score, 0.10) AS vendor_risk_score, coalesce(g.graph_risk_score, 0.05) AS graph_risk_score,
    greatest(0.0, least(1.0, 0.50 * ml.ml_score + 0.25 * r.rule_score + 0.15 * coalesce(p.vendor_risk_score, 0.10)
      + 0.10 * coalesce(g.graph_risk_score, 0.05))) AS anomaly_score
  FROM ruled r JOIN ml USING (tx_id) LEFT JOIN (SELECT * FROM profile WHERE vendor_id % 10 <> 3) p USING (vendor_id)
    LEFT JOIN (SELECT * FROM graph_risk WHERE vendor_id % 10 <> 4) g USING (vendor_id))"""


def blended(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth vendor is unknown to either risk table, so that the defaults are met."""
    rows = spend(spark, sf, agency=True)
    vendor_risk = vr.vendor_risk_profile(rows).filter(F.col("vendor_id") % 10 != 3)
    graph_risk = graph.graph_risk_score(rows).filter(F.col("vendor_id") % 10 != 4)
    scored, _ = rules.score_batch(model_rows(spark, sf), vendor_risk, graph_risk)
    return scored


@query("blend_score", BLEND_SQL + """
SELECT tx_id, round(ml_score, 5) AS ml_score, rule_score, vendor_risk_score, graph_risk_score, round(anomaly_score, 8) AS anomaly_score FROM blended""")
def _(spark, sf):
    return blended(spark, sf).select("tx_id", F.round("ml_score", 5).alias("ml_score"), "rule_score", "vendor_risk_score",
                                     "graph_risk_score", F.round("anomaly_score", 8).alias("anomaly_score"))


@query("score_batch", BLEND_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE round(anomaly_score, 9) >= 0.5) AS anomaly_count FROM blended""")
def _(spark, sf):
    df = blended(spark, sf)
    return df.agg(F.count("*").alias("total"),
                  F.sum(F.when(F.round("anomaly_score", 9) >= 0.5, 1).otherwise(0)).alias("anomaly_count"))


# attributions of three features per line, given as arithmetic on the keys
ATTR_SQL = """[{'f': 'is_weekend_payment', 'raw': 1.0, 'impact': ((l_orderkey % 17) - 8) / 10.0},
  {'f': 'amount_log', 'raw': 0.0, 'impact': ((l_partkey % 19) - 9) / 10.0},
  {'f': 'rolling_7d_sum', 'raw': cents / 100.0, 'impact': ((l_linenumber % 5) - 2) / 10.0}]"""


def attributions() -> Column:
    item = lambda name, raw, impact: F.struct(F.lit(name).alias("feature"), raw.alias("raw_value"), impact.alias("impact"))
    return F.array(
        item("is_weekend_payment", F.lit(1.0), (F.col("l_orderkey") % 17 - 8) / F.lit(10.0)),
        item("amount_log", F.lit(0.0), (F.col("l_partkey") % 19 - 9) / F.lit(10.0)),
        item("rolling_7d_sum", F.col("cents") / F.lit(100.0), (F.col("l_linenumber") % 5 - 2) / F.lit(10.0)))


@query("top_reason", "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem), a AS (SELECT *, list_sort("
       "list_transform(" + ATTR_SQL + """, lambda x, i: {'size': abs(x.impact), 'pos': -i, 'x': x}), 'DESC')[1].x AS top FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN '[Rules: A; B] ' ELSE '' END ||
  CASE top.f WHEN 'is_weekend_payment' THEN 'Payment issued on a weekend — unusual in standard procurement cycles'
    WHEN 'amount_log' THEN 'Transaction amount $' || format('{:,.2f}', cents / 100.0) || ' is unusually ' || CASE WHEN top.impact > 0 THEN 'elevated' ELSE 'suppressed' END
    ELSE 'Vendor''s 7-day rolling spend is $' || format('{:,.2f}', top.raw) || ' (unusual short-window burst)' END AS reason FROM a""")
def _(spark, sf):
    rule_names = F.when(F.col("l_linenumber") == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    df = spend(spark, sf).withColumns({"attributions": attributions(), "triggered_rules": rule_names})
    return rules.top_reason(df).select("l_orderkey", "l_linenumber", "l_partkey", F.col("vendor_id").alias("l_suppkey"),
                                       F.col("top_reason").alias("reason"))


# ---------------------------------------------------------------------------------------------
# cases


@query("unscored_batch", "WITH " + """t AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS tx_id,
  l_suppkey AS vendor_id, l_shipdate AS ts FROM lineitem WHERE l_linestatus <> 'F')
SELECT tx_id, vendor_id, ts FROM t ORDER BY ts DESC, tx_id LIMIT 200""")
def _(spark, sf):
    return C.unscored_batch(spend(spark, sf), 200).select("tx_id", "vendor_id", "ts")


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = spend(spark, sf)
    return df.select("tx_id", "cents", "l_linenumber", F.col("ml_score").alias("anomaly_score"), (F.col("ml_score") >= 0.5).alias("is_anomaly"),
                     F.concat(F.lit("reason "), "l_linenumber").alias("top_reason"), attributions().alias("attributions"))


def stored_cases(spark: SparkSession, sf: str) -> DataFrame:
    return spend(spark, sf).filter(F.col("l_linenumber") % 3 == 0).select(
        F.concat(F.lit("old-"), "tx_id").alias("case_id"), "tx_id", F.lit(0.1).alias("ml_score"), F.lit("before").alias("summary"),
        F.lit("IN_REVIEW").alias("status"), F.lit("LOW").alias("risk_level"), F.lit(0).cast("bigint").alias("impact_cents"))


UPSERT_SQL = """u AS (
  SELECT tx_id, CASE WHEN l_linenumber % 3 = 0 THEN 'old-' ELSE 'case-' END || tx_id AS case_id, ml_score, 'reason ' || l_linenumber AS summary,
    CASE WHEN l_linenumber % 3 = 0 THEN 'IN_REVIEW' ELSE 'OPEN' END AS status,
    CASE WHEN ml_score >= 0.8 THEN 'HIGH' WHEN ml_score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, cents AS impact_cents,
    CASE WHEN l_linenumber % 3 = 0 THEN 'updated' ELSE 'created' END AS action
  FROM spend WHERE {where})"""


@query("case_upsert", "WITH " + SPEND_SQL + "," + UPSERT_SQL.format(where="TRUE") + " SELECT * FROM u")
def _(spark, sf):
    return C.case_upsert(scored_rows(spark, sf), stored_cases(spark, sf)).drop("attributions")


@query("case_upsert_anomalies", "WITH " + SPEND_SQL + "," + UPSERT_SQL.format(where="ml_score >= 0.5 OR l_linenumber % 3 = 0")
       + " SELECT * FROM u")
def _(spark, sf):
    return C.case_upsert(scored_rows(spark, sf), stored_cases(spark, sf), "ANOMALIES_ONLY").drop("attributions")


@query("orchestration_summary", "WITH " + SPEND_SQL + "," + UPSERT_SQL.format(where="TRUE") + """
SELECT count(*) AS scanned, count(*) AS scored, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
  count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk, count(*) FILTER (WHERE risk_level = 'LOW') AS low_risk,
  count(*) FILTER (WHERE action = 'created') AS cases_created, count(*) FILTER (WHERE action = 'updated') AS cases_updated FROM u""")
def _(spark, sf):
    scored = scored_rows(spark, sf)
    return C.orchestration_summary(scored, C.case_upsert(scored, stored_cases(spark, sf)))


SUMMARY_SQL = """CASE ln WHEN 1 THEN 'Split invoice just under threshold, near approval' WHEN 2 THEN 'Weekend BURST' WHEN 3 THEN 'rapid cluster of same-day sequential duplicate backdated round-number split billing'
  WHEN 4 THEN 'rapid' ELSE 'nothing' END"""


def summary_text() -> Column:
    ln = F.col("ln")
    return (F.when(ln == 1, "Split invoice just under threshold, near approval").when(ln == 2, "Weekend BURST")
            .when(ln == 3, "rapid cluster of same-day sequential duplicate backdated round-number split billing")
            .when(ln == 4, "rapid").otherwise("nothing"))


def signalled(spark: SparkSession, sf: str) -> DataFrame:
    return C.risk_signals(cases(spark, sf, agency=True, category=True).withColumn("summary", summary_text()))


KEYWORDS_SQL = "list_filter([" + ", ".join(f"'{k}'" for k in C.KEYWORDS) + "], lambda k: contains(txt, k))"
SIGNAL_SQL = WITH_CASES + f""", sig AS (
  SELECT *, {KEYWORDS_SQL} AS kw FROM (SELECT *, lower(concat_ws(' ', description, category, {SUMMARY_SQL})) AS txt FROM cases))"""


@query("risk_signals", SIGNAL_SQL + " SELECT case_id, len(kw) AS signal_hits, array_to_string(kw[1:6], ';') AS keywords FROM sig")
def _(spark, sf):
    return signalled(spark, sf).select("case_id", F.col("signal_hits").cast("bigint").alias("signal_hits"),
                                       F.concat_ws(";", "keywords").alias("keywords"))


@query("escalation_guardrail", SIGNAL_SQL + """, g AS (
  SELECT *, ln % 4 = 0 AS model_says, len(kw) AS hits, ml_score >= 0.8 AS hard, ml_score >= 0.6 AND len(kw) >= 2 AS soft FROM sig)
SELECT case_id, model_says OR hard OR soft AS escalate, CASE WHEN model_says OR NOT (hard OR soft) THEN 'LOW' WHEN hard THEN 'HIGH' ELSE 'MEDIUM' END AS level,
  CASE WHEN model_says OR NOT (hard OR soft) THEN 'fine'
    ELSE 'Escalation guardrail applied by policy (ml_score=' || format('{:.3f}', ml_score) || ', signal_hits=' || hits || '). fine' END AS reason FROM g""")
def _(spark, sf):
    df = signalled(spark, sf).withColumns({"escalate": F.col("ln") % 4 == 0, "reason": F.lit("fine"), "risk_level": F.lit("LOW")})
    return C.escalation_guardrail(df).select("case_id", "escalate", F.col("risk_level").alias("level"), "reason")


def payload_fields(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("tx_id").alias("transaction_id"), (F.col("cents") / F.lit(100.0)).alias("amount"),
                     F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.col("agency").alias("awarding_agency"),
                     F.col("summary").alias("shap_summary"))


@query("triage_payload", SIGNAL_SQL + """
SELECT case_id, tx_id, cents / 100.0 AS amount, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS date, agency, len(kw) AS hits, TRUE AS fits FROM sig""")
def _(spark, sf):
    out = C.triage_payload(payload_fields(signalled(spark, sf)))
    f = lambda p: F.get_json_object("payload", f"$.{p}")
    return out.select("case_id", f("transaction_id").alias("tx_id"), f("amount").cast("double").alias("amount"), f("date").alias("date"),
                      f("awarding_agency").alias("agency"), f("risk_signals.signal_hits").cast("bigint").alias("hits"),
                      (F.length("payload") <= C.TRIAGE_CHARS).alias("fits"))


@query("audit_payload", WITH_CASES + """, placed AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
SELECT case_id, 2 AS clauses, 2 * least(length(text), 850) AS clause_chars, TRUE AS fits, TRUE AS valid
FROM cases LEFT JOIN placed ON place = l_orderkey % (SELECT count(*) FROM documents) WHERE escalated""")
def _(spark, sf):
    """Three clauses of one document per escalated case; the last one must not be sent."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    # the place of every document in the order of ids, from counts per slice
    places = cut(running_sums(texts.select("doc_id", F.lit(1).alias("one")), [], ["doc_id"], ["one"]))
    n = max(places.count(), 1)
    docs = texts.join(places.select("doc_id", F.col("one_before").alias("place")), "doc_id")
    rows = cases(spark, sf, agency=True, category=True).filter("escalated").withColumn("summary", summary_text())
    hit = lambda score: F.struct(F.col("doc_id").cast("string").alias("contract_id"), F.lit(score).alias("score"), F.col("text").alias("text"))
    joined = payload_fields(rows).join(docs, F.col("l_orderkey") % n == F.col("place"), "left")
    out = C.audit_payload(joined.withColumn("hits", F.array(hit(0.9), hit(0.5), hit(0.3))))
    return out.select("case_id", F.size("clauses").alias("clauses"),
                      F.aggregate("clauses", F.lit(0).cast("bigint"), lambda a, c: a + F.length(c["text"])).alias("clause_chars"),
                      (F.length("payload") <= C.AUDIT_CHARS).alias("fits"), F.get_json_object("payload", "$.transaction").isNotNull().alias("valid"))


def reports(df: DataFrame) -> DataFrame:
    """Model reports: line 2 breaks the confidence, line 3 the verdict, line 4 the JSON, line 5 the rationale."""
    ln = F.col("ln")
    text = F.to_json(F.struct(
        F.when(ln == 3, "GUILTY").otherwise("FRAUD").alias("verdict"), F.concat(F.lit("clause "), ln).alias("violated_clause"),
        F.when(ln == 2, 1.5).otherwise(0.75).alias("confidence"), F.when(ln == 5, "short").otherwise("a long enough rationale").alias("rationale"),
        F.lit("text").alias("cited_clause_text")))
    return df.select("case_id", F.when(ln == 4, F.lit('{"verdict":')).otherwise(text).alias("report"))


@query("verdict_validation", WITH_CASES + """
SELECT case_id, 'FRAUD' AS verdict, 'clause ' || ln AS violated_clause, 0.75 AS confidence FROM cases WHERE ln NOT IN (2, 3, 4, 5)""", doubles=["confidence"])
def _(spark, sf):
    good, _ = C.verdict_validation(reports(cases(spark, sf)))
    return good.select("case_id", "verdict", "violated_clause", "confidence")


@query("apply_verdicts", WITH_CASES + """
SELECT case_id, CASE WHEN ln = 7 THEN escalated ELSE escalated OR ln = 1 END AS escalated, CASE WHEN ln = 7 THEN risk_level ELSE 'MEDIUM' END AS risk,
  CASE WHEN ln = 7 THEN verdict WHEN NOT (escalated OR ln = 1) THEN 'INCONCLUSIVE' WHEN ln IN (1, 6) THEN 'FRAUD' ELSE verdict END AS verdict,
  CASE WHEN ln = 7 THEN 0.5 WHEN NOT (escalated OR ln = 1) THEN NULL WHEN ln IN (1, 6) THEN 0.75 ELSE 0.5 END AS confidence FROM cases""", doubles=["confidence"])
def _(spark, sf):
    df = cases(spark, sf)
    stored = df.select("case_id", "escalated", "risk_level", "verdict", F.lit(0.5).alias("confidence"),
                       F.lit(None).cast("string").alias("violated_clause"), F.lit(None).cast("string").alias("cited_clause_text"))
    triage = df.filter(F.col("ln") != 7).select("case_id", (F.col("escalated") | (F.col("ln") == 1)).alias("escalate"), F.lit("MEDIUM").alias("risk_level"))
    good, _ = C.verdict_validation(reports(df.filter(F.col("ln") != 7)))
    return C.apply_verdicts(stored, triage, good).select("case_id", "escalated", F.col("risk_level").alias("risk"), "verdict", "confidence")


@query("budget_select", WITH_CASES + """, b AS (SELECT * FROM cases WHERE ln = 1 AND updated_at >= TIMESTAMP '2001-09-01'),
f AS (SELECT case_id, ml_score, 0 AS turn, updated_at AS event_at FROM b WHERE ml_score >= 0.5 ORDER BY updated_at DESC, case_id LIMIT 500),
p AS (SELECT case_id, ml_score, 1 AS turn, created_at AS event_at FROM cases WHERE verdict IS NULL AND case_id NOT IN (SELECT case_id FROM b) ORDER BY created_at DESC, case_id LIMIT 500)
SELECT case_id, turn, rank FROM (SELECT *, row_number() OVER (ORDER BY turn, event_at DESC, case_id) AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM p))
WHERE rank <= 500 AND ml_score >= 0.5""")
def _(spark, sf):
    df = cases(spark, sf)
    batch = df.filter((F.col("ln") == 1) & (F.col("updated_at") >= F.lit("2001-09-01").cast("timestamp_ntz"))).withColumn("ts", F.col("updated_at"))
    return C.budget_select(batch, df.filter(F.col("verdict").isNull()), 500, 0.5).select("case_id", "turn", "rank")


@query("list_cases", WITH_CASES + """ SELECT case_id, status, verdict, risk_level, ml_score, created_at FROM cases
WHERE status = 'OPEN' AND verdict = 'FRAUD' AND risk_level = 'HIGH' AND ml_score >= 0.82 ORDER BY created_at DESC, case_id LIMIT 20 OFFSET 20""")
def _(spark, sf):
    found = C.list_cases(cases(spark, sf), "OPEN", "FRAUD", "high", 0.82)
    return C.page_of(found, "case_id", 2, 20).select("case_id", "status", "verdict", "risk_level", "ml_score", "created_at")


SEEK_SQL = """, f AS (SELECT * FROM cases WHERE status = 'OPEN' AND risk_level = 'HIGH'), c AS (SELECT created_at AS t, case_id AS k FROM f WHERE case_id = (SELECT min(case_id) FROM f))
SELECT case_id, risk_level, created_at FROM f, c WHERE created_at < t OR (created_at = t AND case_id > k) ORDER BY created_at DESC, case_id LIMIT 20"""


@query("list_cases_after", WITH_CASES + SEEK_SQL)
def _(spark, sf):
    """The page that follows a cursor, from a written listing of all cases: the open high-risk ones after the one with the smallest id."""
    listed = paging.write_listing(cases(spark, sf), f"{shared_folder(spark)}/cases-{uuid.uuid4().hex}", "created_at", "case_id")
    wanted = (F.col("status") == "OPEN") & (F.col("risk_level") == "HIGH")
    seen = cases(spark, sf).filter(wanted).agg(F.min_by("created_at", "case_id"), F.min("case_id")).first()
    return listed.after(tuple(seen), 20, wanted).select("case_id", "risk_level", "created_at")


@query("list_cases_deep_page", WITH_CASES + """ SELECT case_id, created_at FROM cases ORDER BY created_at DESC, case_id LIMIT 50 OFFSET (SELECT count(*) // 100 * 50 FROM cases)""")
def _(spark, sf):
    """A page from the middle of all cases, by its number."""
    listed = paging.write_listing(cases(spark, sf), f"{shared_folder(spark)}/cases-{uuid.uuid4().hex}", "created_at", "case_id")
    return listed.page(listed.total // 100 + 1, 50).select("case_id", "created_at")


@query("list_cases_total", WITH_CASES + " SELECT count(*) AS total FROM cases WHERE status = 'OPEN' AND risk_level = 'HIGH'")
def _(spark, sf):
    return C.list_cases(cases(spark, sf), status="OPEN", risk="HIGH").agg(F.count("*").alias("total"))


@query("case_detail", WITH_CASES + """ SELECT case_id, tx_id, vendor_id, ml_score, status FROM cases
WHERE case_id = (SELECT min(case_id) FROM cases)""")
def _(spark, sf):
    df = cases(spark, sf)
    first = df.agg(F.min("case_id")).first()[0]
    return C.case_detail(df, first).select("case_id", "tx_id", "vendor_id", "ml_score", "status")


@query("case_status_update", WITH_CASES + """ SELECT case_id, CASE WHEN ln = 2 THEN 'CLOSED' ELSE status END AS status FROM cases""")
def _(spark, sf):
    """Each case of line 2 is changed twice, the later change wins; a change to an unknown case is dropped."""
    df = cases(spark, sf).select("case_id", "status", "ln")
    change = lambda s, at: df.filter("ln = 2").select("case_id", F.lit(s).alias("status"), F.lit(at).alias("at"))
    stray = df.filter("ln = 3").select(F.concat("case_id", F.lit("x")).alias("case_id"), F.lit("OPEN").alias("status"), F.lit(9).alias("at"))
    return C.update_cases(df.drop("ln"), change("IN_REVIEW", 1).unionByName(change("CLOSED", 2)).unionByName(stray), ["at"])


@query("case_notes_update", WITH_CASES + """ SELECT case_id, status, CASE WHEN ln = 4 THEN 'checked' END AS notes FROM cases""")
def _(spark, sf):
    df = cases(spark, sf)
    notes = df.filter("ln = 4").select("case_id", F.lit("checked").alias("notes"), F.lit(1).alias("at"))
    return C.update_cases(df.select("case_id", "status", F.lit(None).cast("string").alias("notes")), notes, ["at"])


# ---------------------------------------------------------------------------------------------
# action plans


@query("create_action_plan", WITH_BOTH + """ SELECT plan_id, CAST(case_ref AS VARCHAR) AS case_id, status FROM plans
UNION ALL SELECT 'new-' || case_id, case_id, 'PENDING' FROM cases WHERE ln = 1""")
def _(spark, sf):
    old = plans(spark, sf).select("plan_id", F.col("case_ref").cast("string").alias("case_id"), "status")
    df = cases(spark, sf).filter("ln = 1").select("case_id")
    ask = lambda c: df.select(F.concat(F.lit("new-"), "case_id").alias("plan_id"), c.alias("case_id"))
    requests = ask(F.col("case_id")).unionByName(ask(F.concat(F.lit("no-"), "case_id")))
    return C.create_action_plan(old, requests, df)


@query("action_plan_status_update", WITH_PLANS + """ SELECT plan_id, CASE case_ref % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'CANCELLED' ELSE status END AS status,
  CASE case_ref % 4 WHEN 0 THEN 100 ELSE saved_cents END AS saved_cents, CASE WHEN case_ref % 4 = 0 THEN TIMESTAMP '2002-01-01' END AS completed_at,
  CASE WHEN case_ref % 4 < 2 THEN 'n' END AS notes FROM plans""")
def _(spark, sf):
    df = plans(spark, sf)
    kind = F.col("case_ref") % 4
    changes = df.filter(kind < 2).select("plan_id", F.when(kind == 0, "COMPLETED").otherwise("CANCELLED").alias("status"), F.lit("n").alias("notes"),
                                         F.when(kind == 0, F.lit(100).cast("bigint")).alias("saved_cents"))
    stored = df.select("plan_id", "status", "saved_cents", F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("string").alias("notes"))
    return C.action_plan_status_update(stored, changes, F.lit("2002-01-01").cast("timestamp_ntz"))


@query("list_action_plans", WITH_PLANS + """ SELECT plan_id, owner_email, status, created_at FROM plans WHERE status = 'COMPLETED' AND owner_email = 'owner7@audit.example'
ORDER BY created_at DESC, plan_id LIMIT 20""")
def _(spark, sf):
    found = C.list_action_plans(plans(spark, sf), "COMPLETED", "owner7@audit.example")
    return C.page_of(found, "plan_id", 1, 20).select("plan_id", "owner_email", "status", "created_at")


@query("top_risk_cases", WITH_CASES + """ SELECT case_id, risk_level, escalated FROM cases WHERE risk_level = 'HIGH' OR escalated ORDER BY created_at DESC, case_id LIMIT 5""")
def _(spark, sf):
    return C.top_risk_cases(cases(spark, sf)).select("case_id", "risk_level", "escalated")


@query("risk_mix", WITH_CASES + """ SELECT count(*) FILTER (WHERE risk_level = 'HIGH') AS high, count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium,
  count(*) FILTER (WHERE risk_level = 'LOW') AS low FROM cases""")
def _(spark, sf):
    return C.risk_mix(cases(spark, sf))


# ---------------------------------------------------------------------------------------------
# metrics

ROI_SQL = """SELECT count(*) AS completed_action_plans, coalesce(sum(saved_cents), 0) / 100.0 AS total_dollars_saved,
  round(coalesce(sum(saved_cents) / count(saved_cents), 0) / 100.0, 4) AS average_dollars_saved FROM plans WHERE status = 'COMPLETED'"""


@query("roi_metrics", WITH_PLANS + ROI_SQL)
def _(spark, sf):
    return kpi.roi_metrics(plans(spark, sf)).withColumn("average_dollars_saved", F.round("average_dollars_saved", 4))


COVERAGE_SQL = """SELECT (SELECT count(*) FROM lineitem) AS total_transactions, count(*) AS audited_transactions, count(*) FILTER (WHERE status = 'OPEN') AS open_cases,
  count(*) FILTER (WHERE status = 'IN_REVIEW') AS in_review_cases, count(*) FILTER (WHERE status = 'CLOSED') AS closed_cases,
  round(count(*) / (SELECT count(*) FROM lineitem) * 100, {0}) AS audit_coverage_pct FROM cases"""


@query("coverage_metrics", WITH_CASES + COVERAGE_SQL.format(4))
def _(spark, sf):
    return kpi.coverage_metrics(spend(spark, sf), cases(spark, sf))


@query("progress_metrics", WITH_CASES + """, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS s, (SELECT count(*) FROM cases) AS c FROM lineitem)
SELECT n AS total_transactions, s AS scored_transactions, n - s AS unscored_transactions, round(s / n * 100, 2) AS score_coverage_pct, c AS audit_cases,
  round(c / n * 100, 4) AS audit_coverage_pct FROM t""")
def _(spark, sf):
    return kpi.progress_metrics(spend(spark, sf), cases(spark, sf))


@query("source_metrics", DIMS_SQL + """
SELECT source_system, agency_family, category_family, count(*) AS total_transactions, count(*) FILTER (WHERE is_scored) AS scored_transactions,
  count(*) FILTER (WHERE ml_score >= 0.4) AS audit_cases, count(*) FILTER (WHERE ml_score >= 0.8 OR (ml_score >= 0.6 AND l_linenumber % 2 = 0)) AS escalated_cases,
  count(*) FILTER (WHERE ml_score >= 0.8) AS high_risk_cases, round(avg(ml_score), 4) AS avg_ml_score, round(count(*) FILTER (WHERE is_scored) / count(*) * 100, 2) AS score_coverage_pct
FROM dims GROUP BY ALL""")
def _(spark, sf):
    rows = spend(spark, sf, agency=True, category=True).withColumns({"agency": agency_text(), "category": category_text()})
    return kpi.source_metrics(rows, cases(spark, sf))


@query("realtime_snapshot", WITH_BOTH + ", c AS (" + COVERAGE_SQL.format(2) + "), r AS (" + ROI_SQL + ") SELECT * FROM c, r")
def _(spark, sf):
    return kpi.realtime_snapshot(spend(spark, sf), cases(spark, sf), plans(spark, sf)).withColumn(
        "average_dollars_saved", F.round("average_dollars_saved", 4))


@query("recent_cases", WITH_CASES + " SELECT case_id, risk_level, status, ml_score, escalated, updated_at FROM cases ORDER BY updated_at DESC, case_id LIMIT 8")
def _(spark, sf):
    return kpi.recent_cases(cases(spark, sf)).select("case_id", "risk_level", "status", "ml_score", "escalated", "updated_at")


EVENTS_SQL = WITH_BOTH + """, e AS (
  (SELECT 'case:' || case_id || ':' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS id, updated_at AS event_at, 'CASE' AS entity, 'Case ' || substr(case_id, 1, 8) || ' updated' AS title,
    'Risk=' || risk_level || ' · Status=' || status AS detail, risk_level AS severity FROM cases ORDER BY updated_at DESC, case_id LIMIT 8)
  UNION ALL
  (SELECT 'plan:' || plan_id || ':' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S'), updated_at, 'ACTION_PLAN', 'Action plan ' || substr(plan_id, 1, 8) || ' ' || lower(status),
    'Type=' || action_type || ' · Owner=' || owner_email, CASE WHEN status = 'COMPLETED' THEN 'MEDIUM' ELSE 'LOW' END FROM plans ORDER BY updated_at DESC, plan_id LIMIT 8)),
top AS (SELECT * FROM e ORDER BY event_at DESC, id LIMIT 12)"""


@query("recent_events", EVENTS_SQL + " SELECT * FROM top")
def _(spark, sf):
    return kpi.recent_events(cases(spark, sf), plans(spark, sf))


@query("notifiable_events", EVENTS_SQL + """ SELECT id, title, severity FROM top WHERE severity IN ('HIGH', 'MEDIUM')
  AND id NOT IN (SELECT id FROM top ORDER BY id LIMIT 2) ORDER BY event_at DESC, id LIMIT 3""")
def _(spark, sf):
    events = kpi.recent_events(cases(spark, sf), plans(spark, sf))
    return kpi.notifiable_events(events, events.orderBy("id").limit(2)).select("id", "title", "severity")
