import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.likelihood import log_gamma
from ledgerlens.operators import btyd, churn, value

PARAMS = {"r": 0.69, "alpha": 67.25, "a": 0.045, "b": 0.59}


def test_log_gamma_matches_the_standard_library():
    z = np.array([0.01, 0.3, 1.0, 2.5, 7.9, 8.0, 55.5, 1e4])
    assert log_gamma(z) == pytest.approx([math.lgamma(v) for v in z], rel=1e-11, abs=1e-11)


def _integrated(params, x, tx, T, t):
    """P(alive) and expected purchases by numeric integration over rate and dropout."""
    r, alpha, a, b = (params[k] for k in ("r", "alpha", "a", "b"))
    # stretch both ends of the dropout probability (its prior is singular there), all in logarithms
    u, wu = np.polynomial.legendre.leggauss(1200)
    u, wu = (u + 1) / 2, wu / 2
    cube = u ** 3  # the rate prior may be singular at zero as well
    rate = -np.log1p(-cube) * 8 / (alpha + T)
    log_rate_weight = np.log(8 / (alpha + T) * 3 * u ** 2 / (1 - cube) * wu)
    m = 40
    log_d = np.logaddexp(m * np.log(u), m * np.log1p(-u))
    log_p, log_q = m * np.log(u) - log_d, m * np.log1p(-u) - log_d
    log_p_weight = np.log(m) + (m - 1) * (np.log(u) + np.log1p(-u)) - 2 * log_d + np.log(wu)
    L, lp, lq = rate[:, None], log_p[None, :], log_q[None, :]
    base = ((r - 1) * np.log(L) - alpha * L + (a - 1) * lp + (b - 1) * lq + x * np.log(L)
            + log_rate_weight[:, None] + log_p_weight[None, :])
    alive = np.exp(base + x * lq - L * T)
    gone = np.exp(base + lp + (x - 1) * lq - L * tx) if x > 0 else 0.0
    total = (alive + gone).sum()
    future = -np.expm1(-L * np.exp(lp) * t) / np.exp(lp)
    return alive.sum() / total, (alive * future).sum() / total


@pytest.mark.parametrize("params", [PARAMS, {"r": 2.0, "alpha": 30.0, "a": 1.6, "b": 2.5}])
@pytest.mark.parametrize("x,tx,T", [(0, 0, 0), (0, 0, 300), (1, 40, 200), (7, 310, 330), (25, 600, 900)])
def test_closed_forms_agree_with_integration(spark, params, x, tx, T):
    df = spark.createDataFrame([(x, tx, T)], "x bigint, t_x int, T int")
    row = df.select(btyd.prob_alive(params).alias("p"), btyd.purchase_curve(params, [30, 90, 360]).alias("e")).first()
    alive, expected = _integrated(params, x, tx, T, 90)
    assert row["p"] == pytest.approx(alive, rel=1e-5)
    assert row["e"][1] == pytest.approx(expected, rel=1e-5)
    assert row["e"][0] < row["e"][1] < row["e"][2]
    single = df.select(btyd.expected_purchases(params, 90)).first()[0]
    assert single == pytest.approx(row["e"][1], rel=1e-10)


def test_pole_is_refused():
    with pytest.raises(ValueError):
        btyd.expected_purchases({**PARAMS, "a": 1.0}, 90)


def _simulated(n, r, alpha, a, b, seed=3):
    rng = np.random.default_rng(seed)
    lam, p = rng.gamma(r, 1 / alpha, n), rng.beta(a, b, n)
    T = rng.integers(200, 700, n)
    rows = []
    for i in range(n):
        t, x, last = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / lam[i])
            if t > T[i]:
                break
            x, last = x + 1, t
            if rng.random() < p[i]:
                break
        rows.append((i, x, last, int(T[i])))
    return pd.DataFrame(rows, columns=["customer_id", "x", "t_x", "T"])


def test_purchase_parameters_are_recovered(spark):
    truth = {"r": 1.5, "alpha": 60.0, "a": 0.8, "b": 2.5}
    fitted = btyd.bgnbd_fit(spark.createDataFrame(_simulated(6000, **truth)), penalizer=0.0)
    assert fitted["r"] == pytest.approx(1.5, rel=0.15) and fitted["alpha"] == pytest.approx(60, rel=0.15)
    assert fitted["a"] / (fitted["a"] + fitted["b"]) == pytest.approx(0.8 / 3.3, rel=0.12)


def test_spend_parameters_are_recovered(spark):
    rng = np.random.default_rng(5)
    n, p, q, v = 8000, 6.0, 4.0, 15.0
    x = rng.integers(1, 12, n)
    nu = rng.gamma(q, 1 / v, n)
    m = rng.gamma(p * x, 1 / (x * nu))
    fitted = btyd.gamma_gamma_fit(spark.createDataFrame(pd.DataFrame({"x": x, "m": m})), penalizer=0.0)
    mean = fitted["p"] * fitted["v"] / (fitted["q"] - 1)
    assert mean == pytest.approx(p * v / (q - 1), rel=0.05) and fitted["q"] == pytest.approx(q, rel=0.2)


def test_summary_collapses_days(spark):
    rows = [("1", "2020-01-01 09:00:00", 5.0), ("1", "2020-01-01 18:00:00", 7.0), ("1", "2020-01-11 00:00:01", 20.0), ("2", "2020-01-31 00:00:00", 1.0)]
    tx = spark.createDataFrame(rows, "customer_id string, t string, order_value double").withColumn("invoice_ts", F.to_timestamp("t"))
    got = {r["customer_id"]: (r["x"], r["t_x"], r["T"], r["m"]) for r in btyd.btyd_summary(tx).collect()}
    assert got == {"1": (1, 10, 30, 20.0), "2": (0, 0, 0, 0.0)}


def test_probabilistic_scores_match_the_single_operators(spark):
    summary = spark.createDataFrame([("1", 3, 100, 150, 20.0), ("2", 0, 0, 80, 0.0)], "customer_id string, x bigint, t_x int, T int, m double")
    gamma = {"p": 2.0, "q": 3.5, "v": 60.0}
    scores = {r["customer_id"]: r for r in btyd.probabilistic_scores(summary, PARAMS, gamma).collect()}
    valued = btyd.clv_discounted(summary, PARAMS, gamma).collect()
    assert [r["customer_id"] for r in valued] == ["1"]
    assert scores["1"]["clv_12m"] == pytest.approx(valued[0]["clv_12m"])
    assert scores["2"]["clv_12m"] is None and scores["2"]["prob_alive"] is None and scores["2"]["predicted_purchases_90d"] > 0
    assert 0 < valued[0]["clv_90d"] < valued[0]["clv_12m"]


def test_risk_boundaries(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 39.9, 40, 40.1, 69.9, 70, 70.1, 100)], "churn_probability_pct double")
    def tiers(closed):
        return "".join(r["risk_tier"][0] for r in churn.churn_risk_tiers(df, closed=closed).orderBy("churn_probability_pct").collect())
    assert tiers("left") == "LLMMMHHH" and tiers("right") == "LLLMMMHH"
    with pytest.raises(ValueError):
        churn.churn_risk_tiers(df, closed="both")


def test_tier_summary_lists_empty_tiers(spark):
    df = spark.createDataFrame([("High", 80.0, 10.0)], "risk_tier string, churn_probability_pct double, monthly_value double")
    assert [(r["risk_tier"], r["customers"]) for r in churn.tier_summary(df).collect()] == [("High", 1), ("Medium", 0), ("Low", 0)]


def test_monthly_value_variants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], list(churn.CHARGE_COLUMNS))
    assert churn.monthly_value(df).first()["monthly_value"] == 10.0
    assert churn.monthly_value(df, day_charge_times=3).first()["monthly_value"] == 3.0


def test_value_tiers_and_opportunity(spark):
    df = spark.createDataFrame([(str(i), float(i) if i else None, "At Risk", 100.0) for i in range(11)],
                               "customer_id string, clv_12m double, segment string, monetary double")
    tiers = {r["customer_id"]: r["clv_tier"] for r in value.clv_tier(df).collect()}
    assert "0" not in tiers and tiers["1"] == "Low CLV" and tiers["10"] == "High CLV"
    rows = {r["segment"]: r for r in value.revenue_opportunity(spark, df).collect()}
    assert rows["At Risk"]["converted"] == 1 and rows["Total"]["opportunity"] == pytest.approx(1 * 100 * 0.20 * 0.15)


def test_sample_is_repeatable_and_bounded(spark):
    df = spark.range(1000)
    a = value.bounded_sample(df.repartition(3), F.col("id"), 50)
    b = value.bounded_sample(df.repartition(11), F.col("id"), 50)
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect()) and a.count() == 50


def test_curves_of_whole_arrays_equal_the_column(spark, monkeypatch):
    monkeypatch.setattr(btyd, "CURVE_ROWS", 7)  # several chunks
    rows = [(x, float(t) if x else 0.0, float(T)) for x in (0, 1, 2, 9, 40) for T in (0, 1, 30, 700, 2500) for t in (0, T // 2, T)]
    df = spark.createDataFrame(rows + [(None, 1.0, 2.0), (3, None, 2.0), (3, 1.0, None)], "x long, t_x double, T double")
    days = [30 * j for j in range(1, 13)]
    for params in ({"r": 0.9, "alpha": 40.0, "a": 0.4, "b": 2.1}, {"r": 3.0, "alpha": 9.0, "a": 1.7, "b": 0.6}):
        both = df.select(btyd.purchase_curve(params, days).alias("old"), btyd.curve_of_rows(params, days).alias("new"), *df.columns).collect()
        for r in both:
            if None in (r["x"], r["t_x"], r["T"]):
                assert r["new"] is None
            else:
                assert r["new"] == pytest.approx(r["old"], rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError, match="pole"):
        btyd.curve_of_rows({"r": 1.0, "alpha": 9.0, "a": 1.0, "b": 0.6}, days)


def test_probabilistic_scores_need_no_interpreted_series(spark, monkeypatch):
    monkeypatch.delattr(btyd, "purchase_curve")
    summary = spark.createDataFrame([("a", 2, 10, 50, 20.0), ("b", 0, 0, 50, 0.0)], "customer_id string, x long, t_x int, T int, m double")
    scored = btyd.probabilistic_scores(summary, {"r": 0.9, "alpha": 40.0, "a": 0.4, "b": 2.1}, {"p": 6.0, "q": 4.0, "v": 15.0}).orderBy("customer_id").collect()
    assert scored[0]["clv_12m"] > scored[0]["clv_90d"] > 0 and scored[1]["clv_12m"] is None and scored[1]["predicted_purchases_90d"] > 0
