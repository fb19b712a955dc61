"""Window features against loops written from their definitions, in both physical forms."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from procspark.operators import features as feat

DAY = 86_400_000_000


def frame(spark, rows, agency=False):
    cols = "vendor_id string, cents bigint, ts timestamp_ntz, tx_id string" + (", agency string" if agency else "")
    return spark.createDataFrame(rows, cols)


def invoices(*items):
    return [(v, int(a * 100), datetime.fromisoformat(t), f"{i:04d}") for i, (v, a, t) in enumerate(items)]


def run(spark, *items, **kw):
    out = feat.feature_matrix(frame(spark, invoices(*items)), **kw).toPandas()
    return out.sort_values("tx_id").reset_index(drop=True)


def test_shape_and_no_nulls(spark):
    out = run(spark, ("v1", 1000, "2026-01-01"), ("v1", 2000, "2026-01-15"), ("v1", 1500, "2026-01-20"),
              ("v2", 500, "2026-01-05"), ("v2", 600, "2026-01-25"))
    assert out[feat.FEATURES].shape == (5, 22) and not out[feat.FEATURES].isna().any().any()


def test_first_row_has_no_history(spark):
    out = run(spark, ("v1", 1000, "2026-01-01"), ("v1", 2000, "2026-01-10"))
    assert out.vendor_30d_velocity[0] == 0 and out.days_since_last_invoice[0] == 0
    assert out.amount_vs_vendor_avg[0] == pytest.approx(1000 / 1001)


def test_values(spark):
    assert run(spark, ("v1", 99, "2026-01-01")).amount_log[0] == pytest.approx(math.log1p(99))
    assert run(spark, ("v1", 1000, "2026-01-09"), ("v1", 1000, "2026-01-10")).is_weekend_payment.tolist() == [0, 1]
    assert run(spark, ("v1", 100, "2026-01-01"), ("v1", 200, "2026-01-05"), ("v1", 50, "2026-01-20")).vendor_30d_velocity[2] == 300
    assert run(spark, ("v1", 500, "2026-01-01"), ("v1", 100, "2026-02-10")).vendor_30d_velocity[1] == 0
    assert run(spark, ("v1", 100, "2026-01-01"), ("v1", 100, "2026-01-31")).vendor_30d_velocity[1] == 100


@pytest.mark.parametrize("hot", [100_000, 0])
def test_equal_times_count_by_position(spark, hot):
    out = run(spark, ("v1", 9000, "2026-01-01"), ("v1", 9100, "2026-01-01"), ("v1", 9200, "2026-01-01"), hot_rows=hot, n_slices=3)
    assert out.invoice_count_24h.tolist() == [0, 1, 2]
    assert out.consecutive_small_invoices.tolist() == [0, 1, 2]
    assert out.max_invoices_7d_window.tolist() == [0, 0, 2]


def random_rows(seed, n=400):
    rnd = random.Random(seed)
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        step = rnd.choice([timedelta(days=rnd.randrange(120)), timedelta(hours=rnd.randrange(200)), timedelta(microseconds=rnd.randrange(10**12))])
        cents = rnd.choice([rnd.randrange(1, 5_000_000), 950_000, 1_000_000, 5_000_000, rnd.randrange(1, 40) * 50_000])
        rows.append((f"v{rnd.choice([0, 0, 0, 1, 2])}", cents, base + step, f"{i:05d}", rnd.choice(["a", "b", None])))
    return rows


def loop(rows):
    """Quadratic and literal."""
    out = {}
    for v in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[3]))
        us = [(r[2] - datetime(1970, 1, 1)) // timedelta(microseconds=1) for r in mine]
        money = [r[1] / 100 for r in mine]
        for i, r in enumerate(mine):
            back = lambda w: [j for j in range(i) if us[j] >= us[i] - w]
            m30, m7, m48 = back(30 * DAY), back(7 * DAY), back(2 * DAY)
            a30 = np.array([money[j] for j in m30])
            run_len = 0
            while run_len < i and money[i - 1 - run_len] < 10_000:
                run_len += 1
            hours = [us[j] // 3_600_000_000 for j in range(max(0, i - 10), i)]
            gaps = np.diff(np.array(hours, dtype=float))
            f = {
                "vendor_30d_velocity": a30.sum(), "invoice_count_7d": len(m7), "invoice_count_30d": len(m30),
                "rolling_7d_sum": sum(money[j] for j in m7), "invoice_count_24h": len(back(DAY)), "invoice_count_48h": len(m48),
                "invoice_sum_48h": sum(money[j] for j in m48),
                "days_since_last_invoice": ((us[i] - us[i - 1]) // 1_000_000) / 86400 if i else 0,
                "amount_vs_vendor_avg": money[i] / ((np.mean(money[:i]) if i else money[0]) + 1),
                "max_invoices_7d_window": max(sum(us[j] <= us[k] < us[j] + 7 * DAY for k in range(i)) for j in range(i)) if i >= 2 else 0,
                "consecutive_small_invoices": run_len,
                "amount_std_30d": a30.std() if len(a30) >= 2 else 0,
                "freq_change_rate": len(m7) / (len(m30) / 4 + 0.1),
                "amount_zscore_30d": (money[i] - a30.mean()) / (a30.std() + 1) if len(a30) >= 2 else 0,
                "invoice_spacing_cv": gaps.std() / (gaps.mean() + 0.1) if i >= 3 and len(gaps) >= 2 and gaps.mean() > 0 else 0,
                "small_invoice_cluster_14d": sum(money[j] < 10_000 for j in back(14 * DAY)),
            }
            out[r[3]] = f
    return pd.DataFrame.from_dict(out, orient="index").sort_index()


@pytest.mark.parametrize("hot", [100_000, 50, 0])
def test_all_windows_against_the_loop(spark, hot):
    rows = random_rows(7)
    got = feat.feature_matrix(frame(spark, rows, True), hot_rows=hot, n_slices=5).toPandas().set_index("tx_id").sort_index()
    want = loop(rows)
    for c in want.columns:
        assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-6), c


def test_peers(spark):
    rows = random_rows(3, 120)
    got = feat.feature_matrix(frame(spark, rows, True)).toPandas()
    with_agency = got[got.agency.notna()]
    means = with_agency.groupby("agency").cents.mean() / 100
    rates = with_agency.groupby(["agency", "vendor_id"]).invoice_count_30d.mean().groupby("agency").mean()
    for r in got.itertuples():
        if r.agency is None:
            assert r.amount_vs_category_avg == 1.0 and r.invoice_freq_vs_category == pytest.approx(r.invoice_count_30d / 1.1)
        else:
            assert r.amount_vs_category_avg == pytest.approx(r.cents / 100 / (means[r.agency] + 1))
            assert r.invoice_freq_vs_category == pytest.approx(r.invoice_count_30d / (rates[r.agency] + 0.1))


@pytest.mark.parametrize("hot", [100_000, 0])
def test_as_of_excludes_equal_times(spark, hot):
    rows = [r[:4] for r in random_rows(11, 200)] + [(None, 100, datetime(2024, 1, 5), "x")]
    got = feat.temporal_as_of(frame(spark, rows), hot_rows=hot, n_slices=4).toPandas().set_index("tx_id")
    assert len(got) == len(rows) and (got.loc["x", feat.AS_OF] == 0).all()
    for v, cents, ts, tx in rows[:-1]:
        prior = [r for r in rows[:-1] if r[0] == v and r[2] < ts]
        a30 = np.array([r[1] / 100 for r in prior if r[2] >= ts - timedelta(days=30)])
        g = got.loc[tx]
        assert g.invoice_count_30d == len(a30)
        assert g.vendor_avg_amount == pytest.approx(a30.mean() if len(a30) else 0)
        std = a30.std() if len(a30) else 0.0
        if len(set(a30)) > 1:
            assert g.amount_zscore_30d == pytest.approx((cents / 100 - a30.mean()) / std)
        else:
            assert g.amount_zscore_30d == 0
        assert g.invoice_count_48h == sum(r[2] >= ts - timedelta(hours=48) for r in prior)


def test_single_vector(spark):
    def one(amount, day, **given):
        cols = {"cents": int(amount * 100), "ts": datetime.fromisoformat(day), **given}
        return feat.single_feature_vector(spark.createDataFrame(pd.DataFrame([cols]))).toPandas().iloc[0]

    assert one(1000, "2026-01-14T12:00:00").amount_log == pytest.approx(math.log1p(1000))
    assert one(1000, "2026-01-10").is_weekend_payment == 1 and one(1000, "2026-01-11").is_weekend_payment == 1
    assert one(-500, "2026-01-14").amount_log == 0
    v = one(500, "2026-01-14", vendor_30d_spend=10_000.0, days_since_last_invoice=3.0, vendor_avg_amount=400.0)
    assert (v.vendor_30d_velocity, v.days_since_last_invoice) == (10_000, 3)
    assert v.amount_vs_vendor_avg == pytest.approx(500 / 401)
    assert one(500, "2026-01-14", invoice_count_7d=2.0, invoice_count_30d=4.0).freq_change_rate == pytest.approx(2 / 1.1)


def test_scaled_windows_are_made_once(spark):
    """The rows are ranked and then scaled: the windows stand before both, not in the plan of the result."""
    import __spark_entry__
    plan = __spark_entry__.queries()["robust_scale"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
