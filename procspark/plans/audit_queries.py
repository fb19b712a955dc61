"""Registered queries: features, rules, scoring, vendor risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procspark.operators import features as feat
from procspark.operators import rules
from procspark.operators import vendor_risk as vr
from procspark.registry import query
from procspark.session import cut
from procspark.sources.tables import BURST_SQL, SPEND_SQL, burst, spend, table

# ---------------------------------------------------------------------------------------------
# features; the SQL orders one vendor's rows by a composite key (time, position within equal times)

MEASURES_SQL = """
keyed AS (
  SELECT *, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY vendor_id, ts ORDER BY tx_id) - 1 AS tie
  FROM {src}
), k AS (
  SELECT *, us * 2048 + tie AS k, cents / 100.0 AS money,
         row_number() OVER (PARTITION BY vendor_id ORDER BY us, tie) AS pos,
         CAST(floor(us / 3600000000.0) AS BIGINT) AS hour
  FROM keyed
), g AS (
  SELECT *, hour - lag(hour) OVER (PARTITION BY vendor_id ORDER BY k) AS gap,
         lag(us) OVER (PARTITION BY vendor_id ORDER BY k) AS prev_us,
         1 + count(*) OVER (PARTITION BY vendor_id ORDER BY k
                            RANGE BETWEEN (604800000000 - 1) * 2048 + 1023 PRECEDING AND 1 PRECEDING) AS span7,
         CASE WHEN cents >= 1000000 THEN pos END AS big_pos
  FROM k
), w AS (
  SELECT *,
    count(*) OVER d1 AS n24, count(*) OVER d2 AS n48, sum(cents) OVER d2 AS sum48,
    count(*) OVER d7 AS n7, sum(cents) OVER d7 AS sum7,
    count(*) FILTER (WHERE cents < 1000000) OVER d14 AS small14,
    count(*) OVER d30 AS n30, sum(cents) OVER d30 AS sum30, stddev_pop(money) OVER d30 AS std30,
    sum(cents) OVER prior AS sum_prior, max(span7) OVER prior AS max7, max(big_pos) OVER prior AS last_big,
    count(gap) OVER last9 AS gap_n, avg(gap) OVER last9 AS gap_avg, stddev_pop(gap) OVER last9 AS gap_std
  FROM g
  WINDOW
    d1 AS (PARTITION BY vendor_id ORDER BY k RANGE BETWEEN 86400000000 * 2048 + 1023 PRECEDING AND 1 PRECEDING),
    d2 AS (PARTITION BY vendor_id ORDER BY k RANGE BETWEEN 172800000000 * 2048 + 1023 PRECEDING AND 1 PRECEDING),
    d7 AS (PARTITION BY vendor_id ORDER BY k RANGE BETWEEN 604800000000 * 2048 + 1023 PRECEDING AND 1 PRECEDING),
    d14 AS (PARTITION BY vendor_id ORDER BY k RANGE BETWEEN 1209600000000 * 2048 + 1023 PRECEDING AND 1 PRECEDING),
    d30 AS (PARTITION BY vendor_id ORDER BY k RANGE BETWEEN 2592000000000 * 2048 + 1023 PRECEDING AND 1 PRECEDING),
    prior AS (PARTITION BY vendor_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    last9 AS (PARTITION BY vendor_id ORDER BY k ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)
), temporal AS (
  SELECT tx_id, vendor_id, agency, cents, ts,
    coalesce(sum_prior / (100.0 * (pos - 1)), 0.0) AS vendor_avg_amount,
    ln(1 + greatest(money, 0)) AS amount_log,
    coalesce(sum30, 0) / 100.0 AS vendor_30d_velocity,
    coalesce(floor((us - prev_us) / 1000000.0) / 86400.0, 0.0) AS days_since_last_invoice,
    CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend_payment,
    money / (coalesce(sum_prior / (100.0 * (pos - 1)), money) + 1.0) AS amount_vs_vendor_avg,
    CAST(n7 AS DOUBLE) AS invoice_count_7d,
    CAST(n30 AS DOUBLE) AS invoice_count_30d,
    coalesce(sum7, 0) / 100.0 AS rolling_7d_sum,
    CASE WHEN pos > 2 THEN CAST(max7 AS DOUBLE) ELSE 0.0 END AS max_invoices_7d_window,
    CAST(pos - 1 - coalesce(last_big, 0) AS DOUBLE) AS consecutive_small_invoices,
    CASE WHEN n30 >= 2 THEN std30 ELSE 0.0 END AS amount_std_30d,
    CASE WHEN (cents >= 1000000 AND cents % 50000 = 0) OR cents % 100000 = 0 THEN 1.0 ELSE 0.0 END AS is_round_amount,
    CAST(n24 AS DOUBLE) AS invoice_count_24h,
    CAST(n48 AS DOUBLE) AS invoice_count_48h,
    coalesce(sum48, 0) / 100.0 AS invoice_sum_48h,
    CASE WHEN (cents >= 950000 AND cents < 1000000) OR (cents >= 2375000 AND cents < 2500000)
           OR (cents >= 9500000 AND cents < 10000000) OR (cents >= 23750000 AND cents < 25000000)
         THEN 1.0 ELSE 0.0 END AS approval_limit_proximity,
    n7 / (n30 / 4.0 + 0.1) AS freq_change_rate,
    CASE WHEN n30 >= 2 THEN (money - sum30 / (100.0 * n30)) / (std30 + 1.0) ELSE 0.0 END AS amount_zscore_30d,
    CASE WHEN pos > 3 AND gap_n >= 2 AND gap_avg > 0 THEN gap_std / (gap_avg + 0.1) ELSE 0.0 END AS invoice_spacing_cv,
    CAST(small14 AS DOUBLE) AS small_invoice_cluster_14d
  FROM w
)"""

MATRIX_SQL = MEASURES_SQL + """, agency_mean AS (
  SELECT agency, sum(cents) / (100.0 * count(*)) AS m FROM temporal GROUP BY agency
), agency_rate AS (
  SELECT agency, avg(r) AS r FROM (
    SELECT agency, vendor_id, avg(invoice_count_30d) AS r FROM temporal GROUP BY agency, vendor_id) GROUP BY agency
), matrix AS (
  SELECT t.*, (cents / 100.0) / (m + 1.0) AS amount_vs_category_avg,
         invoice_count_30d / (r + 0.1) AS invoice_freq_vs_category
  FROM temporal t JOIN agency_mean USING (agency) JOIN agency_rate USING (agency)
)"""

SPEND_TEMPORAL = "WITH " + SPEND_SQL + "," + MEASURES_SQL.format(src="spend")
SPEND_MATRIX = "WITH " + SPEND_SQL + "," + MATRIX_SQL.format(src="spend")
BURST_TEMPORAL = "WITH " + BURST_SQL + "," + MEASURES_SQL.format(src="burst")
BURST_MATRIX = "WITH " + BURST_SQL + "," + MATRIX_SQL.format(src="burst")

KEYS = ["vendor_id", "tx_id", "ts", "cents", "agency"]
DIGITS = 6
# whole seconds over 86,400 can fall exactly between two numbers of six digits, but not of eight
DIGITS_OF = {c: 8 if c == "days_since_last_invoice" else DIGITS for c in feat.FEATURES}


def spend_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spend(spark, sf, agency=True).select(*KEYS)


def burst_rows(spark: SparkSession, sf: str) -> DataFrame:
    return burst(spark, sf).select(*KEYS)


def rounded(df: DataFrame, cols: list[str], digits: int | None = None) -> DataFrame:
    n = lambda c: digits or DIGITS_OF.get(c, DIGITS)
    return df.select(*[F.round(c, n(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _register_feature(name: str) -> None:
    """One query per feature: the same builder, and Catalyst drops the frames that are not asked for."""
    peer = name in ("amount_vs_category_avg", "invoice_freq_vs_category")
    source = "matrix" if peer else "temporal"
    text = (SPEND_MATRIX if peer else BURST_TEMPORAL) + f"\nSELECT tx_id, vendor_id, round({name}, {DIGITS_OF[name]}) AS {name} FROM {source}"

    @query(name, text, doubles=[name])
    def _(spark: SparkSession, sf: str) -> DataFrame:
        if name == "amount_vs_category_avg":
            df = feat.amount_vs_agency(spend_rows(spark, sf))
        elif peer:
            df = feat.frequency_vs_agency(cut(feat.temporal_features(spend_rows(spark, sf), count_on=spend(spark, sf))))
        else:
            # the agency is not needed here, so no dimension is joined
            df = feat.temporal_features(burst_rows(spark, sf))
        return df.select("tx_id", "vendor_id", F.round(name, DIGITS_OF[name]).alias(name))


for _name in feat.FEATURES:
    _register_feature(_name)


@query("feature_matrix", SPEND_MATRIX + "\nSELECT tx_id, vendor_id, "
       + ", ".join(f"round({c}, {DIGITS_OF[c]}) AS {c}" for c in feat.FEATURES) + " FROM matrix",
       doubles=feat.FEATURES)
def _(spark, sf):
    return rounded(feat.feature_matrix(spend_rows(spark, sf), count_on=spend(spark, sf)).select("tx_id", "vendor_id", *feat.FEATURES),
                   feat.FEATURES)


@query("feature_matrix_bursts", BURST_MATRIX + "\nSELECT tx_id, vendor_id, "
       + ", ".join(f"round({c}, {DIGITS_OF[c]}) AS {c}" for c in feat.FEATURES) + " FROM matrix",
       doubles=feat.FEATURES)
def _(spark, sf):
    return rounded(feat.feature_matrix(burst_rows(spark, sf)).select("tx_id", "vendor_id", *feat.FEATURES),
                   feat.FEATURES)


AS_OF_SQL = "WITH " + SPEND_SQL + """, s AS (
  SELECT tx_id, vendor_id, cents, epoch_us(ts) AS us, cents / 100.0 AS money FROM spend
), w AS (
  SELECT tx_id, vendor_id, money,
    count(*) OVER d30 AS n30, sum(cents) OVER d30 AS s30, stddev_pop(money) OVER d30 AS std30,
    count(*) OVER d7 AS n7, sum(cents) OVER d7 AS s7, count(*) OVER d1 AS n24, count(*) OVER d2 AS n48
  FROM s WINDOW
    d1 AS (PARTITION BY vendor_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING),
    d2 AS (PARTITION BY vendor_id ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING),
    d7 AS (PARTITION BY vendor_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING),
    d30 AS (PARTITION BY vendor_id ORDER BY us RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING)
)
SELECT tx_id, vendor_id, CAST(n30 AS DOUBLE) AS invoice_count_30d,
  round(coalesce(s30 / (100.0 * n30), 0.0), 6) AS vendor_avg_amount,
  round(coalesce(std30, 0.0), 4) AS amount_std_30d,
  CAST(n7 AS DOUBLE) AS invoice_count_7d, coalesce(s7, 0) / 100.0 AS rolling_7d_sum,
  CAST(n24 AS DOUBLE) AS invoice_count_24h, CAST(n48 AS DOUBLE) AS invoice_count_48h,
  round(CASE WHEN n30 > 1 AND std30 > 1e-6 THEN (money - s30 / (100.0 * n30)) / std30 ELSE 0.0 END, 4) AS amount_zscore_30d
FROM w"""


@query("temporal_features_as_of", AS_OF_SQL)
def _(spark, sf):
    df = feat.temporal_as_of(spend(spark, sf).select("vendor_id", "tx_id", "ts", "cents"))
    df = df.select("tx_id", "vendor_id", *feat.AS_OF)
    return rounded(rounded(df, ["vendor_avg_amount"]), ["amount_std_30d", "amount_zscore_30d"], 4)


@query("single_feature_vector", SPEND_TEMPORAL + """
SELECT tx_id, vendor_id, round(amount_log, 6) AS amount_log, 0.0 AS vendor_30d_velocity, 0.0 AS days_since_last_invoice,
  is_weekend_payment, round((cents / 100.0) / (vendor_avg_amount + 1.0), 6) AS amount_vs_vendor_avg,
  invoice_count_7d, invoice_count_30d, round(rolling_7d_sum, 6) AS rolling_7d_sum, 0.0 AS max_invoices_7d_window,
  0.0 AS consecutive_small_invoices, 0.0 AS amount_std_30d, is_round_amount, 0.0 AS invoice_count_24h,
  0.0 AS invoice_count_48h, 0.0 AS invoice_sum_48h, approval_limit_proximity,
  round(CASE WHEN invoice_count_30d > 0 THEN invoice_count_7d / (invoice_count_30d / 4.0 + 0.1) ELSE 0.0 END, 6)
    AS freq_change_rate,
  0.0 AS amount_zscore_30d, 0.0 AS invoice_spacing_cv, 0.0 AS small_invoice_cluster_14d,
  1.0 AS amount_vs_category_avg, 1.0 AS invoice_freq_vs_category
FROM temporal""", doubles=feat.FEATURES)
def _(spark, sf):
    rows = spend(spark, sf).select("vendor_id", "tx_id", "ts", "cents")
    history = feat.temporal_features(rows).select(
        "vendor_id", "tx_id", "ts", "cents", "vendor_avg_amount", "invoice_count_7d", "invoice_count_30d",
        "rolling_7d_sum")
    vec = feat.single_feature_vector(history).select("tx_id", "vendor_id", *feat.FEATURES)
    return rounded(vec, feat.FEATURES)


@query("read_transactions", "WITH " + SPEND_SQL + """
SELECT vendor_id, coalesce(TRY_CAST(amount AS DOUBLE), 0.0) AS amount, ts, agency FROM spend""")
def _(spark, sf):
    return spend(spark, sf, agency=True).select(
        "vendor_id", F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0)).alias("amount"), "ts", "agency")


# ---------------------------------------------------------------------------------------------
# rules

RULE_CASES = """
  consecutive_small_invoices >= 3 AS r1,
  is_weekend_payment = 1 AND amount_vs_vendor_avg > 2.0 AS r2,
  invoice_count_24h > 3 AS r3,
  approval_limit_proximity = 1 AS r4,
  is_round_amount = 1 AND cents >= 5000000 AS r5,
  invoice_count_7d > 5 AS r6,
  invoice_sum_48h > greatest(vendor_avg_amount, 1.0) * 3.0 AND invoice_count_48h >= 2 AS r7"""
RULE_SQL = """, hits AS (SELECT *, """ + RULE_CASES + """ FROM temporal), ruled AS (
  SELECT *, least(CASE WHEN r1 THEN 30 ELSE 0 END + CASE WHEN r2 THEN 20 ELSE 0 END + CASE WHEN r3 THEN 35 ELSE 0 END
    + CASE WHEN r4 THEN 30 ELSE 0 END + CASE WHEN r5 THEN 20 ELSE 0 END + CASE WHEN r6 THEN 20 ELSE 0 END
    + CASE WHEN r7 THEN 25 ELSE 0 END, 100) / 100.0 AS rule_score,
    concat_ws(';', CASE WHEN r1 THEN 'SPLIT_BILLING_BURST' END, CASE WHEN r2 THEN 'WEEKEND_HIGH_VALUE' END,
      CASE WHEN r3 THEN 'BURST_24H' END, CASE WHEN r4 THEN 'NEAR_APPROVAL_THRESHOLD' END,
      CASE WHEN r5 THEN 'LARGE_ROUND_NUMBER' END, CASE WHEN r6 THEN 'VELOCITY_7D_HIGH' END,
      CASE WHEN r7 THEN 'BURST_48H_HIGH_SPEND' END) AS triggered
  FROM hits)"""

RULE_QUERIES = {
    "rule_split_billing_burst": "SPLIT_BILLING_BURST", "rule_weekend_high_value": "WEEKEND_HIGH_VALUE",
    "rule_burst_24h": "BURST_24H", "rule_near_threshold": "NEAR_APPROVAL_THRESHOLD",
    "rule_large_round_number": "LARGE_ROUND_NUMBER", "rule_velocity_7d": "VELOCITY_7D_HIGH",
    "rule_burst_48h_spend": "BURST_48H_HIGH_SPEND",
}


def _register_rule(name: str, rule: str, at: int) -> None:
    @query(name, BURST_TEMPORAL + RULE_SQL + f"\nSELECT tx_id, vendor_id, round(cents / 100.0, 2) AS amount FROM ruled WHERE r{at}")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        df = feat.temporal_features(burst_rows(spark, sf))
        return df.filter(rules.rule_hit(rule)).select(
            "tx_id", "vendor_id", F.round(F.col("cents") / F.lit(100.0), 2).alias("amount"))


for _i, (_query, _rule) in enumerate(RULE_QUERIES.items(), 1):
    _register_rule(_query, _rule, _i)


@query("evaluate_rules", BURST_TEMPORAL + RULE_SQL + """
SELECT tx_id, vendor_id, rule_score, triggered,
       CAST(len(string_split(triggered, ';')) - CASE WHEN triggered = '' THEN 1 ELSE 0 END AS BIGINT) AS detail_count
FROM ruled""")
def _(spark, sf):
    df = rules.evaluate_rules(feat.temporal_features(burst_rows(spark, sf)))
    return df.select("tx_id", "vendor_id", "rule_score", F.concat_ws(";", "triggered_rules").alias("triggered"),
                     F.size("rule_details").cast("bigint").alias("detail_count"))


@query("flagged_invoices", SPEND_TEMPORAL + RULE_SQL + """
SELECT tx_id, vendor_id, agency, round(cents / 100.0, 2) AS amount, rule_score, triggered
FROM ruled WHERE rule_score > 0""")
def flagged_invoices(spark, sf):
    df = rules.evaluate_rules(feat.temporal_features(spend_rows(spark, sf), count_on=spend(spark, sf))).filter(F.col("rule_score") > 0)
    return df.select("tx_id", "vendor_id", "agency", F.round(F.col("cents") / F.lit(100.0), 2).alias("amount"),
                     "rule_score", F.concat_ws(";", "triggered_rules").alias("triggered"))


# ---------------------------------------------------------------------------------------------
# vendor risk

RISK_SQL = """
risk_in AS (SELECT vendor_id, cents, ts, cents / 100.0 AS money, epoch_us(ts) AS us FROM {src}),
profile AS (
  SELECT vendor_id, count(*) AS invoices,
    greatest(0.0, least(1.0, round(
      0.30 * least(5.0 * sum(CASE WHEN (cents >= 950000 AND cents < 1000000) OR (cents >= 2375000 AND cents < 2500000)
           OR (cents >= 9500000 AND cents < 10000000) OR (cents >= 23750000 AND cents < 25000000) THEN 1 ELSE 0 END) / count(*), 1.0)
    + 0.25 * least(3.0 * sum(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END) / count(*), 1.0)
    + 0.20 * least(3.0 * sum(CASE WHEN (cents >= 1000000 AND cents % 50000 = 0) OR cents % 100000 = 0 THEN 1 ELSE 0 END) / count(*), 1.0)
    + 0.15 * least((CASE WHEN count(*) > 1 THEN stddev_pop(money) ELSE 0 END)
                   / greatest(sum(cents) / 100.0 / count(*), 1.0) / 5.0, 1.0)
    + 0.10 * least((CASE WHEN count(*) > 1 THEN count(*) / (greatest((max(us) - min(us)) / 86400000000.0, 1.0) / 30.0)
                    ELSE 1.0 END) / 10.0, 1.0), 4))) AS vendor_risk_score
  FROM risk_in GROUP BY vendor_id
)"""
SPEND_RISK = "WITH " + SPEND_SQL + "," + RISK_SQL.format(src="spend")


@query("vendor_risk_profile", SPEND_RISK + "\nSELECT vendor_id, invoices, vendor_risk_score FROM profile")
def _(spark, sf):
    return vr.vendor_risk_profile(spend(spark, sf))


@query("top_risky_vendors", SPEND_RISK + """
SELECT vendor_id, invoices, vendor_risk_score FROM profile ORDER BY vendor_risk_score DESC, vendor_id LIMIT 10""")
def _(spark, sf):
    return vr.top_risky_vendors(vr.vendor_risk_profile(spend(spark, sf)), 10)


def vendors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("name"),
        F.round(F.col("s_acctbal") * 100).cast("bigint").alias("spend_ytd_cents"))


@query("vendor_spend_ytd", """
SELECT s_suppkey AS vendor_id, s_name AS name, coalesce(y.spent, CAST(round(s_acctbal * 100) AS BIGINT)) AS spend_ytd_cents
FROM supplier LEFT JOIN (
  SELECT l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS spent
  FROM lineitem WHERE year(l_shipdate) = 2001 GROUP BY l_suppkey) y ON l_suppkey = s_suppkey""")
def _(spark, sf):
    return vr.vendor_spend_ytd(vendors(spark, sf), spend(spark, sf), 2001).select(
        "vendor_id", "name", "spend_ytd_cents")


@query("vendor_tx_counts", """
SELECT s_suppkey AS vendor_id, s_name AS name, count(l_orderkey) AS tx_count
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY tx_count DESC, vendor_id LIMIT 20""")
def _(spark, sf):
    return vr.vendor_tx_counts(vendors(spark, sf), spend(spark, sf), 20)
