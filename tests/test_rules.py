import pytest
from pyspark.sql import functions as F

from procspark.operators import rules

BASE = dict(cents=100, is_weekend_payment=0.0, amount_vs_vendor_avg=0.0, consecutive_small_invoices=0.0, invoice_count_24h=0.0,
            invoice_count_48h=0.0, invoice_count_7d=0.0, invoice_sum_48h=0.0, vendor_avg_amount=0.0, is_round_amount=0.0)


@pytest.mark.parametrize("given, names, score", [
    (dict(cents=950_000), ["NEAR_APPROVAL_THRESHOLD"], 0.30),
    (dict(cents=1_000_000), [], 0.0),
    (dict(cents=5_000_000, is_round_amount=1.0), ["LARGE_ROUND_NUMBER"], 0.20),
    (dict(invoice_count_24h=3.0), [], 0.0),
    (dict(invoice_count_24h=4.0), ["BURST_24H"], 0.35),
    (dict(is_weekend_payment=1.0, amount_vs_vendor_avg=2.0), [], 0.0),
    (dict(is_weekend_payment=1.0, amount_vs_vendor_avg=2.1), ["WEEKEND_HIGH_VALUE"], 0.20),
    (dict(invoice_sum_48h=4.0, invoice_count_48h=2.0), ["BURST_48H_HIGH_SPEND"], 0.25),
    (dict(cents=960_000, consecutive_small_invoices=3.0, invoice_count_24h=4.0, invoice_count_7d=6.0, invoice_sum_48h=9.0, invoice_count_48h=2.0),
     ["SPLIT_BILLING_BURST", "BURST_24H", "NEAR_APPROVAL_THRESHOLD", "VELOCITY_7D_HIGH", "BURST_48H_HIGH_SPEND"], 1.0),
])
def test_rules(spark, given, names, score):
    row = rules.evaluate_rules(spark.createDataFrame([{**BASE, **given}])).first()
    assert row.triggered_rules == names and row.rule_score == pytest.approx(score)
    assert sorted(row.rule_details) == sorted(names) and all(row.rule_details.values())


def test_detail_text(spark):
    row = rules.evaluate_rules(spark.createDataFrame([{**BASE, "cents": 950_000}])).first()
    assert "$9,500.00" in row.rule_details["NEAR_APPROVAL_THRESHOLD"] and "$10,000 " in row.rule_details["NEAR_APPROVAL_THRESHOLD"]


def test_normalized_decision(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (0.0,)], "d double")
    assert [r[0] for r in df.select(rules.normalized_decision(F.col("d"))).collect()] == [1.0, 0.0, 0.5]


def test_reason_words(spark):
    df = spark.createDataFrame([
        (1_000_000, [], [("amount_log", 9.2, 0.5)]), (1_000_000, ["A"], [("x", 1.0, 0.1), ("amount_log", 9.2, -0.5)]),
        (100, [], [("other", 1.0, 0.25)])],
        "cents bigint, triggered_rules array<string>, attributions array<struct<feature: string, raw_value: double, impact: double>>")
    a, b, c = (r.top_reason for r in rules.top_reason(df).collect())
    assert "10,000.00" in a and "elevated" in a
    assert b.startswith("[Rules: A] ") and "suppressed" in b
    assert c == "Feature 'other' is anomalous (shap=0.2500)"


def test_blend_defaults_for_unknown_vendor(spark):
    df = spark.createDataFrame([{**BASE, "vendor_id": 1, "ml_score": 1.0, "rule_score": 0.0}])
    empty = lambda c: spark.createDataFrame([], f"vendor_id bigint, {c} double")
    row = rules.blend_score(df, empty("vendor_risk_score"), empty("graph_risk_score")).first()
    assert row.anomaly_score == pytest.approx(0.5 + 0.15 * 0.10 + 0.10 * 0.05) and row.is_anomaly


def test_score_batch_sets_invalid_rows_apart(spark):
    rows = [{**BASE, "vendor_id": 1, "tx_id": "a", "ts": "2026-01-01", "ml_score": 0.2},
            {**BASE, "vendor_id": None, "tx_id": "b", "ts": "2026-01-01", "ml_score": 0.2},
            {**BASE, "vendor_id": 1, "tx_id": "c", "ts": None, "ml_score": 0.2}]
    empty = lambda c: spark.createDataFrame([], f"vendor_id bigint, {c} double")
    good, bad = rules.score_batch(spark.createDataFrame(rows), empty("vendor_risk_score"), empty("graph_risk_score"))
    assert [r.tx_id for r in good.collect()] == ["a"] and sorted(r.tx_id for r in bad.collect()) == ["b", "c"]
