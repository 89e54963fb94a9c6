"""Probabilistic value, value reports, churn reports and model quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as b
from checks.prelude import BGNBD, GAMMA
from checks.registry import query
from ledgerlens.functions.scalars import minus_days
from ledgerlens.operators import btyd, churn, clean, cohort, features, metrics, rfm, value
from ledgerlens.sources import artifacts


# ---- probabilistic value at fixed parameters

@query("btyd_summary", "SELECT * FROM btyd", doubles="m")
def _(spark, sf):
    return btyd.btyd_summary(b.retail(spark, sf))


@query("bgnbd_expected_purchases", """
SELECT customer_id, x, round(e, 4) AS predicted_purchases_90d FROM ey WHERE d = 90""", doubles="predicted_purchases_90d")
def _(spark, sf):
    return b.retail_btyd(spark, sf).select(
        "customer_id", "x", F.round(btyd.expected_purchases(BGNBD, 90), 4).alias("predicted_purchases_90d"))


@query("bgnbd_prob_alive", "SELECT customer_id, x, round(1 / (1 + odds), 6) AS prob_alive FROM lapse", doubles="prob_alive")
def _(spark, sf):
    return b.retail_btyd(spark, sf).select("customer_id", "x", F.round(btyd.prob_alive(BGNBD), 6).alias("prob_alive"))


@query("gamma_gamma_expected_value", """
SELECT customer_id, round(expected_spend, 2) AS expected_spend FROM spend_rate WHERE x > 0 AND m > 0""", doubles="expected_spend")
def _(spark, sf):
    return btyd.repeat_buyers(b.retail_btyd(spark, sf)).select(
        "customer_id", F.round(btyd.expected_spend(GAMMA), 2).alias("expected_spend"))


@query("clv_discounted", """
SELECT customer_id, round(clv_90d) AS clv_90d, round(clv_12m) AS clv_12m, round(clv_12m * 0.15) AS clv_12m_profit FROM clv""",
       doubles="clv_90d clv_12m clv_12m_profit")
def _(spark, sf):
    return btyd.clv_discounted(b.retail_btyd(spark, sf), BGNBD, GAMMA).select(
        "customer_id", *[F.round(c).alias(c) for c in ("clv_90d", "clv_12m", "clv_12m_profit")])


@query("save_load_params", "SELECT customer_id, round(1 / (1 + odds), 6) AS prob_alive FROM lapse", doubles="prob_alive")
def _(spark, sf):
    path = b.scratch(spark, "params")
    artifacts.save_params(spark, path, BGNBD)
    params = artifacts.load_params(spark, path)
    return b.retail_btyd(spark, sf).select("customer_id", F.round(btyd.prob_alive(params), 6).alias("prob_alive"))


@query("clv_describe", " UNION ALL ".join(f"""
SELECT '{c}' AS horizon, count({c}) AS n, round(avg({c}), 1) AS mean_clv, round(sum({c})) AS total_clv, round(median({c}), 1) AS median_clv FROM clv"""
       for c in ("clv_90d", "clv_12m")), doubles="mean_clv total_clv median_clv")
def _(spark, sf):
    described = value.clv_describe(btyd.clv_discounted(b.retail_btyd(spark, sf), BGNBD, GAMMA))
    return described.select("horizon", "n", F.round("mean_clv", 1).alias("mean_clv"), F.round("total_clv").alias("total_clv"),
                            F.round("median_clv", 1).alias("median_clv"))


@query("buyer_counts", """
SELECT count(*) FILTER (x = 0) AS one_time, count(*) FILTER (x > 0) AS repeat, round(count(*) FILTER (x = 0) / count(*) * 100, 1) AS one_time_pct,
       round(count(*) FILTER (x > 0) / count(*) * 100, 1) AS repeat_pct FROM btyd""", doubles="one_time_pct repeat_pct")
def _(spark, sf):
    return value.buyer_counts(b.retail_btyd(spark, sf))


# ---- reports over the widened customer table

@query("join_scores_back", """
SELECT customer_id, segment, round(clv_12m) AS clv_12m, round(prob_alive, 6) AS prob_alive, pred_spend, pred_prob, pred_clv_90d FROM valued""",
       doubles="clv_12m prob_alive pred_spend pred_prob pred_clv_90d")
def _(spark, sf):
    return b.valued(spark, sf).select(
        "customer_id", "segment", F.round("clv_12m").alias("clv_12m"), F.round("prob_alive", 6).alias("prob_alive"),
        "pred_spend", "pred_prob", "pred_clv_90d")


@query("combined_clv", """
SELECT customer_id, round(greatest(s - 20000, 0), 4) AS pred_spend, p AS pred_prob, round(greatest(s - 20000, 0) * p, 4) AS pred_clv_90d
FROM (SELECT customer_id, pred_spend AS s, pred_prob AS p FROM valued)""", doubles="pred_spend pred_prob pred_clv_90d")
def _(spark, sf):
    shifted = b.valued(spark, sf).select("customer_id", (F.col("pred_spend") - 20000).alias("pred_spend"), "pred_prob")
    return value.combined_clv(shifted).withColumns({c: F.round(c, 4) for c in ("pred_spend", "pred_clv_90d")})


@query("clv_by_segment", """
SELECT segment, count(*) AS n, round(avg(clv_12m), 1) AS avg_clv, round(sum(clv_12m)) AS total_clv, round(avg(prob_alive), 6) AS avg_prob_alive
FROM valued WHERE clv_12m IS NOT NULL GROUP BY segment""", doubles="avg_clv total_clv avg_prob_alive")
def _(spark, sf):
    return value.clv_by_segment(b.valued(spark, sf)).select(
        "segment", "n", F.round("avg_clv", 1).alias("avg_clv"), F.round("total_clv").alias("total_clv"),
        F.round("avg_prob_alive", 6).alias("avg_prob_alive"))


@query("segment_clv_compare", """
SELECT segment, count(*) AS n_customers, round(avg(prob_alive), 6) AS avg_prob_alive, round(avg(clv_12m), 1) AS avg_clv_12m,
       round(avg(clv_90d), 1) AS avg_clv_90d, round(avg(pred_clv_90d), 1) AS avg_pred_clv_90d, sum(total_spend) AS total_revenue,
       round(sum(total_spend) / sum(sum(total_spend)) OVER () * 100, 1) AS revenue_pct FROM valued GROUP BY segment""",
       doubles="avg_prob_alive avg_clv_12m avg_clv_90d avg_pred_clv_90d total_revenue revenue_pct")
def _(spark, sf):
    c = value.segment_clv_compare(b.valued(spark, sf))
    return c.select("segment", "n_customers", F.round("avg_prob_alive", 6).alias("avg_prob_alive"),
                    *[F.round(m, 1).alias(m) for m in ("avg_clv_12m", "avg_clv_90d", "avg_pred_clv_90d")], "total_revenue", "revenue_pct")


_TIERED = """
SELECT *, CASE WHEN clv_12m >= (SELECT quantile_cont(clv_12m, 0.66) FROM clv) THEN 'High CLV'
               WHEN clv_12m >= (SELECT quantile_cont(clv_12m, 0.33) FROM clv) THEN 'Mid CLV' ELSE 'Low CLV' END AS clv_tier
FROM valued WHERE clv_12m IS NOT NULL"""


@query("clv_tier", f"SELECT customer_id, clv_tier FROM ({_TIERED})")
def _(spark, sf):
    return value.clv_tier(b.valued(spark, sf)).select("customer_id", "clv_tier")


@query("clv_tier_kpis", f"""
SELECT clv_tier, count(*) AS n, round(sum(clv_12m)) AS total_clv, round(avg(clv_12m), 1) AS avg_clv, round(min(clv_12m)) AS from_value,
       round(avg(prob_alive), 6) AS avg_probability FROM ({_TIERED}) GROUP BY clv_tier""", doubles="total_clv avg_clv from_value avg_probability")
def _(spark, sf):
    k = value.clv_tier_kpis(value.clv_tier(b.valued(spark, sf)))
    return k.select("clv_tier", "n", F.round("total_clv").alias("total_clv"), F.round("avg_clv", 1).alias("avg_clv"),
                    F.round("from_value").alias("from_value"), F.round("avg_probability", 6).alias("avg_probability"))


_SCENARIO_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS segment, {round(c * 100)} AS conv_pct, {u}e0 AS uplift, '{d}' AS strategy" for s, c, u, d in value.SCENARIOS)


@query("revenue_opportunity", f"""
WITH lines AS (SELECT segment, strategy, n_customers, CAST(n_customers * conv_pct // 100 AS BIGINT) AS converted, avg_spend * uplift AS uplift_per_customer,
                      (n_customers * conv_pct // 100) * (avg_spend * uplift) * 0.15e0 AS opportunity
               FROM (SELECT segment, count(*) AS n_customers, avg(monetary) AS avg_spend FROM customers GROUP BY segment) JOIN ({_SCENARIO_SQL}) USING (segment))
SELECT * FROM lines UNION ALL SELECT 'Total', NULL, CAST(sum(n_customers) AS BIGINT), CAST(sum(converted) AS BIGINT), NULL, sum(opportunity) FROM lines""",
       doubles="uplift_per_customer opportunity")
def _(spark, sf):
    return value.revenue_opportunity(spark, b.rfm_scored(spark, sf))


_PLAN_SQL = " UNION ALL ".join(
    "SELECT " + ", ".join("'" + t.replace("'", "''") + f"' AS {n}" for t, n in zip((s, *plan), ("segment", "action", "message", "channel", "priority")))
    for s, plan in rfm.SEGMENT_ACTIONS.items())


@query("segment_actions", f"""
SELECT segment, n_customers, avg_clv_12m, action, message, channel, priority
FROM (SELECT segment, count(*) AS n_customers, round(coalesce(avg(clv_12m), 0), 1) AS avg_clv_12m FROM valued GROUP BY segment) JOIN ({_PLAN_SQL}) USING (segment)""",
       doubles="avg_clv_12m")
def _(spark, sf):
    return rfm.segment_actions(b.valued(spark, sf)).withColumn("avg_clv_12m", F.round("avg_clv_12m", 1))


@query("top_n_customers", """
SELECT customer_id, segment, recency, frequency, monetary, total_spend, rfm_score FROM customers ORDER BY total_spend DESC, customer_id LIMIT 50""",
       doubles="monetary total_spend")
def _(spark, sf):
    return value.top_n_customers(b.rfm_scored(spark, sf), "total_spend", 50,
                                 ["customer_id", "segment", "recency", "frequency", "monetary", "total_spend", "rfm_score"])


@query("nlargest", """
SELECT customer_id, x, t_x, "T", round(e, 3) AS predicted_purchases_90d FROM ey WHERE d = 90 ORDER BY e DESC, customer_id LIMIT 10""",
       doubles="predicted_purchases_90d")
def _(spark, sf):
    scored = btyd.score_purchases(b.retail_btyd(spark, sf), BGNBD)
    top = value.top_n_customers(scored, "predicted_purchases_90d", 10, ["customer_id", "x", "t_x", "T", "predicted_purchases_90d"])
    return top.withColumn("predicted_purchases_90d", F.round("predicted_purchases_90d", 3))


@query("top_products_of_top_customers", """
SELECT description, sum(quantity) AS quantity FROM history
WHERE customer_id IN (SELECT customer_id FROM valued ORDER BY pred_clv_90d DESC NULLS LAST, customer_id LIMIT 100)
GROUP BY description ORDER BY quantity DESC, description LIMIT 15""", doubles="quantity")
def _(spark, sf):
    history, _ = clean.temporal_split(b.retail(spark, sf))
    return value.top_products_of_top_customers(b.valued(spark, sf), history, "pred_clv_90d")


_HASH = "((({k}) % 2147483648) * 2654435761) % 4294967296"


@query("bounded_sample", f"""
SELECT customer_id, segment, total_spend FROM customers ORDER BY {_HASH.format(k='CAST(customer_id AS BIGINT)')}, CAST(customer_id AS BIGINT) LIMIT 1000""",
       doubles="total_spend")
def _(spark, sf):
    return value.bounded_sample(b.rfm_scored(spark, sf), F.col("customer_id").cast("bigint"), 1000).select(
        "customer_id", "segment", "total_spend")


@query("scalar_metadata", """
SELECT count(*) AS n_customers, count(DISTINCT segment) AS n_segments, sum(total_spend) AS total_revenue,
       CAST((SELECT max(invoice_ts) FROM retail) AS DATE) AS snapshot,
       (SELECT round(avg(CASE WHEN is_churned THEN 1 ELSE 0 END), 4) FROM churn_days) AS churn_rate, 0.15e0 AS profit_margin FROM customers""",
       doubles="total_revenue churn_rate profit_margin", texts="snapshot")
def _(spark, sf):
    tx = b.retail(spark, sf)
    return value.scalar_metadata(b.rfm_scored(spark, sf), cohort.purchase_interval_churn(tx), clean.snapshot_of(tx))


# ---- subscriber churn

@query("rate_by_dimension", " UNION ALL ".join(f"""
SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, round(avg(label) * 100, 1) AS churn_rate_pct FROM scores GROUP BY 2"""
       for d in ("international_plan", "number_customer_service_calls", "voice_mail_plan")), doubles="churn_rate_pct")
def _(spark, sf):
    scores = b.subscriber_scores(spark, sf)
    parts = [churn.rate_by_dimension(scores, d).select(
        F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level"), "churn_rate_pct")
        for d in ("international_plan", "number_customer_service_calls", "voice_mail_plan")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("rate_and_count_by_state", "SELECT state, avg(label) AS churn, count(*) AS n FROM scores GROUP BY state", doubles="churn")
def _(spark, sf):
    return churn.rate_and_count_by_state(b.subscriber_scores(spark, sf))


def _tiered(spark, sf, closed="left"):
    return churn.monthly_value(churn.churn_risk_tiers(churn.predict_probability(b.subscriber_scores(spark, sf)), closed=closed))


def _tier_sql(op: str) -> str:
    # scores are tenths of a percent, taken from the integer they were made of
    return f"""
SELECT *, CASE WHEN pct {op} 70 THEN 'High' WHEN pct {op} 40 THEN 'Medium' ELSE 'Low' END AS risk_tier
FROM (SELECT *, round(CAST(CAST(score * 100 AS VARCHAR) AS DECIMAL(38, 18)), 1) AS pct,
             CAST(round(CAST(CAST(total_day_charge + total_eve_charge + total_night_charge + total_intl_charge AS DECIMAL(18, 4)) AS DECIMAL(18, 4)), 2) AS DOUBLE) AS monthly_value
      FROM scores)"""


@query("predict_probability", f"""
SELECT subscriber_key, CAST(pct AS DOUBLE) AS churn_probability_pct FROM ({_tier_sql('>=')})""", doubles="churn_probability_pct")
def _(spark, sf):
    return churn.predict_probability(b.subscriber_scores(spark, sf)).select("subscriber_key", "churn_probability_pct")


@query("churn_risk_tiers", f"""
SELECT 'left' AS closed, subscriber_key, risk_tier FROM ({_tier_sql('>=')})
UNION ALL SELECT 'right', subscriber_key, risk_tier FROM ({_tier_sql('>')})""")
def _(spark, sf):
    parts = [_tiered(spark, sf, c).select(F.lit(c).alias("closed"), "subscriber_key", "risk_tier") for c in ("left", "right")]
    return parts[0].unionByName(parts[1])


@query("tier_summary", f"""
SELECT CASE risk_tier WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS position, risk_tier, count(*) AS customers, sum(monthly_value) AS total_rev,
       avg(CAST(pct AS DOUBLE)) AS avg_prob, round(sum(monthly_value) / sum(sum(monthly_value)) OVER () * 100, 1) AS revenue_share_pct
FROM ({_tier_sql('>=')}) GROUP BY risk_tier""", doubles="total_rev avg_prob revenue_share_pct")
def _(spark, sf):
    return churn.tier_summary(_tiered(spark, sf))


@query("revenue_at_risk", f"""
SELECT sum(monthly_value) FILTER (risk_tier = 'High') AS high_tier_revenue, sum(monthly_value) AS total_revenue,
       round(sum(monthly_value) FILTER (risk_tier = 'High') / sum(monthly_value) * 100, 1) AS high_tier_pct FROM ({_tier_sql('>=')})""",
       doubles="high_tier_revenue total_revenue high_tier_pct")
def _(spark, sf):
    return churn.revenue_at_risk(_tiered(spark, sf))


@query("call_list", f"""
SELECT subscriber_key, CAST(pct AS DOUBLE) AS churn_probability_pct, risk_tier, monthly_value, international_plan, number_customer_service_calls, total_day_minutes, voice_mail_plan
FROM ({_tier_sql('>=')}) WHERE risk_tier = 'High' ORDER BY pct DESC, subscriber_key LIMIT 50""", doubles="churn_probability_pct monthly_value total_day_minutes")
def _(spark, sf):
    return churn.call_list(_tiered(spark, sf), "subscriber_key",
                           ["international_plan", "number_customer_service_calls", "total_day_minutes", "voice_mail_plan"])


# ---- model quality from given predictions

@query("train_test_split", f"SELECT subscriber_key, {_HASH.format(k='subscriber_key')} % 10 < 8 AS is_train FROM subscribers")
def _(spark, sf):
    return metrics.hash_split(b.subscribers(spark, sf).select("subscriber_key"), "subscriber_key")


@query("stratified_split", f"""
SELECT subscriber_key, label, place <= floor(0.8e0 * n) AS is_train
FROM (SELECT subscriber_key, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format(k='subscriber_key')}, subscriber_key) AS place,
             count(*) OVER (PARTITION BY label) AS n FROM scores)""")
def _(spark, sf):
    return metrics.stratified_split(b.subscriber_scores(spark, sf).select("subscriber_key", "label"), "subscriber_key").select(
        "subscriber_key", "label", "is_train")


@query("class_weight", """
SELECT subscriber_key, label, CASE WHEN label = 1 THEN (SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) FROM scores) ELSE 1 END AS weight
FROM scores""", doubles="weight")
def _(spark, sf):
    return metrics.class_weight(b.subscriber_scores(spark, sf).select("subscriber_key", "label"))


_PREDICTED = "(SELECT sales_90_value AS actual, 0.08e0 * sales_value_sum / (1 + frequency) AS predicted FROM model_table)"


def _predicted(spark, sf):
    tx = b.retail(spark, sf)
    history, future = clean.temporal_split(tx)
    table = features.left_join_labels(
        features.features_base(history, minus_days(clean.snapshot_of(tx), 90)), features.targets_90d(future))
    return table.select(F.col("sales_90_value").alias("actual"),
                        (0.08 * F.col("sales_value_sum") / (1 + F.col("frequency"))).alias("predicted"))


@query("regression_metrics", f"""
SELECT count(*) AS n, 1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)) AS r2, avg(abs(actual - predicted)) AS mae,
       sqrt(avg(pow(actual - predicted, 2))) AS rmse FROM {_PREDICTED}""", doubles="r2 mae rmse")
def _(spark, sf):
    return metrics.regression_metrics(_predicted(spark, sf))


@query("capped_residuals", f"""
SELECT count(*) AS n, avg(actual - predicted) AS mean_residual, max(abs(actual - predicted)) AS max_abs FROM {_PREDICTED}
WHERE abs(actual - predicted) <= (SELECT quantile_cont(abs(actual - predicted), 0.95) FROM {_PREDICTED})""", doubles="mean_residual max_abs")
def _(spark, sf):
    return metrics.capped_residuals(_predicted(spark, sf)).agg(
        F.count("*").alias("n"), F.avg("residual").alias("mean_residual"), F.max(F.abs("residual")).alias("max_abs"))


@query("classification_metrics", """
SELECT tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
       tn / (tn + fn) AS precision_0, tn / (tn + fp) AS recall_0, 2 * tn / (2 * tn + fp + fn) AS f1_0
FROM (SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
             count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn FROM scores)""",
       doubles="accuracy precision recall f1 precision_0 recall_0 f1_0")
def _(spark, sf):
    return metrics.classification_metrics(b.subscriber_scores(spark, sf))


@query("roc_auc", """
SELECT CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg, (s - p * (p + 1) / 2) / (p * n) AS auc
FROM (SELECT sum(label) AS p, sum(1 - label) AS n, sum(place) FILTER (label = 1) AS s
      FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0e0 AS place FROM scores))""", doubles="auc")
def _(spark, sf):
    return metrics.roc_auc(b.subscriber_scores(spark, sf))


@query("youden_threshold", """
WITH cut AS (SELECT score AS t, sum(sum(label)) OVER (ORDER BY score DESC) AS tp, sum(sum(1 - label)) OVER (ORDER BY score DESC) AS fp,
                    sum(sum(label)) OVER () AS p, sum(sum(1 - label)) OVER () AS n FROM scores GROUP BY score),
     best AS (SELECT *, tp / p - fp / n AS j FROM cut ORDER BY tp / p - fp / n DESC, t DESC LIMIT 1)
SELECT CAST(round(CAST(CAST(t AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE) AS threshold, j AS youden_j, 2 * tp / (tp + fp + p) AS f1_optimal,
       (SELECT 2 * max(tp) / (max(tp) + max(fp) + max(p)) FROM cut WHERE t >= 0.5) AS f1_default FROM best""",
       doubles="threshold youden_j f1_optimal f1_default")
def _(spark, sf):
    return metrics.youden_threshold(b.subscriber_scores(spark, sf))
