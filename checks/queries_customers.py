"""Recency/frequency/monetary, cohorts, features and segment reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as b
from checks.queries_relational import _completed
from checks.registry import query
from ledgerlens.functions.scalars import minus_days
from ledgerlens.operators import clean, cohort, features, rfm, wholesale
from ledgerlens.plans.segmentation import segment_customers


@query("detect_wholesale", """
SELECT customer_id, invoice, stock_code, quantity, price, order_value FROM retail""", doubles="quantity price order_value")
def _(spark, sf):
    return wholesale.detect_wholesale(b.cleaned(spark, sf)).select(
        "customer_id", "invoice", "stock_code", "quantity", "price", "order_value")


@query("wholesale_summary", """
SELECT any_value(value_threshold) AS value_threshold, any_value(quantity_threshold) AS quantity_threshold,
       count(*) FILTER (NOT is_wholesale) AS n_retail, count(*) FILTER (is_wholesale) AS n_wholesale,
       round(count(*) FILTER (NOT is_wholesale) / count(*) * 100, 1) AS retail_pct,
       round(count(*) FILTER (is_wholesale) / count(*) * 100, 1) AS wholesale_pct,
       round(sum(total_spend) FILTER (is_wholesale) / sum(total_spend) * 100, 1) AS wholesale_revenue_pct,
       CAST(sum(n_lines) FILTER (NOT is_wholesale) AS BIGINT) AS n_retail_lines FROM buyer_flag""",
       doubles="value_threshold quantity_threshold retail_pct wholesale_pct wholesale_revenue_pct")
def _(spark, sf):
    return wholesale.wholesale_summary(b.cleaned(spark, sf))


@query("rfm_table", "SELECT * FROM rfm_base", doubles="monetary total_spend")
def _(spark, sf):
    return rfm.rfm_table(b.retail(spark, sf))


@query("rfm_table_orders", "SELECT * FROM rfm_orders", doubles="monetary")
def _(spark, sf):
    return rfm.rfm_table_orders(_completed(spark, sf))


@query("quintile_score_ranked", "SELECT customer_id, frequency, f_score FROM rfm_points")
def _(spark, sf):
    return rfm.quintile_score_ranked(b.rfm_base(spark, sf).select("customer_id", "frequency"), "frequency", "f_score")


@query("quintile_score_raw", "SELECT customer_id, recency, r_score FROM rfm_points")
def _(spark, sf):
    return rfm.quintile_score_raw(b.rfm_base(spark, sf).select("customer_id", "recency"), "recency", "r_score")


@query("rfm_score_quintile", "SELECT customer_id, r_score, f_score, m_score, rfm_score FROM customers")
def _(spark, sf):
    return rfm.rfm_score_quintile(rfm.rfm_table(b.retail(spark, sf))).select(
        "customer_id", "r_score", "f_score", "m_score", "rfm_score")


def _thirds(spark, sf):
    return rfm.rfm_score_tertile(rfm.rfm_table_orders(_completed(spark, sf)))


@query("rfm_score_tertile", "SELECT customer_unique_id, r_score, f_score, m_score, rfm_score, rfm_label FROM rfm_thirds")
def _(spark, sf):
    return _thirds(spark, sf).select("customer_unique_id", "r_score", "f_score", "m_score", "rfm_score", "rfm_label")


@query("scoring_scale_check", """
SELECT e[1] AS p20, e[2] AS p40, e[3] AS p60, e[4] AS p80, t[1] AS p33, t[2] AS p66, CAST(len(list_distinct(e)) AS INTEGER) AS distinct_cuts,
       CASE WHEN len(list_distinct(e)) = 4 THEN '1-5' ELSE '1-3' END AS scale
FROM (SELECT quantile_cont(CAST(frequency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e, quantile_cont(CAST(frequency AS DOUBLE), [0.33, 0.66]) AS t FROM rfm_base)""",
       doubles="p20 p40 p60 p80 p33 p66")
def _(spark, sf):
    return rfm.scoring_scale_check(b.rfm_base(spark, sf))


@query("segment_quintile", "SELECT customer_id, r_score, f_score, m_score, segment FROM customers")
def _(spark, sf):
    scored = b.rfm_scored(spark, sf).drop("segment")
    return rfm.segment_quintile(scored).select("customer_id", "r_score", "f_score", "m_score", "segment")


@query("segment_customers", "SELECT * FROM customers", doubles="monetary total_spend")
def _(spark, sf):
    return segment_customers(b.transactions(spark, sf))


@query("segment_tertile", """
SELECT customer_unique_id, rfm_label,
       CASE WHEN rfm_score >= 8 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 2 THEN 'Loyal Customers'
            WHEN r_score >= 3 AND f_score = 1 THEN 'Recent Customers' WHEN r_score = 2 AND f_score >= 2 THEN 'Potential Loyalists'
            WHEN r_score = 1 AND f_score >= 2 AND m_score >= 2 THEN 'At Risk' WHEN r_score = 1 AND m_score = 3 THEN 'Cannot Lose Them'
            WHEN rfm_score <= 4 THEN 'Hibernating' ELSE 'Need Attention' END AS segment FROM rfm_thirds""")
def _(spark, sf):
    return rfm.segment_tertile(_thirds(spark, sf)).select("customer_unique_id", "rfm_label", "segment")


_PROFILE = """
SELECT segment, count(*) AS n_customers, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency, avg(monetary) AS avg_monetary,
       sum(total_spend) AS total_revenue, avg(rfm_score) AS avg_rfm_score,
       round(sum(total_spend) / sum(sum(total_spend)) OVER () * 100, 1) AS revenue_pct,
       round(count(*) / sum(count(*)) OVER () * 100, 1) AS customer_pct FROM customers GROUP BY segment"""


@query("segment_profile", _PROFILE,
       doubles="avg_recency avg_frequency avg_monetary total_revenue avg_rfm_score revenue_pct customer_pct")
def _(spark, sf):
    return rfm.segment_profile(b.rfm_scored(spark, sf))


@query("share_of_total", """
SELECT segment, sum(total_spend) AS revenue, round(sum(total_spend) / sum(sum(total_spend)) OVER () * 100, 1) AS share_pct
FROM customers GROUP BY segment""", doubles="revenue share_pct")
def _(spark, sf):
    grouped = b.rfm_scored(spark, sf).groupBy("segment").agg(F.sum("total_spend").alias("revenue"))
    return rfm.share_of_total(grouped, "revenue", "share_pct")


@query("portfolio_kpis", """
SELECT count(*) AS n_customers, count(DISTINCT segment) AS n_segments, count(*) FILTER (segment = 'Champions') AS champions,
       round(count(*) FILTER (segment = 'Champions') / count(*) * 100, 1) AS champions_pct, count(*) FILTER (segment = 'At Risk') AS at_risk,
       count(*) FILTER (segment = 'Cannot Lose Them') AS cannot_lose,
       sum(total_spend) FILTER (segment IN ('At Risk', 'Cannot Lose Them')) AS revenue_at_risk FROM customers""",
       doubles="champions_pct revenue_at_risk")
def _(spark, sf):
    return rfm.portfolio_kpis(b.rfm_scored(spark, sf))


@query("crosstab_segment_cluster", """
SELECT segment, CAST(CAST(customer_id AS BIGINT) % 4 AS INTEGER) AS km_cluster, count(*) AS n FROM customers GROUP BY 1, 2""")
def _(spark, sf):
    labelled = b.rfm_scored(spark, sf).withColumn("km_cluster", (F.col("customer_id").cast("bigint") % 4).cast("int"))
    return rfm.crosstab_segment_cluster(labelled)


# ---- descriptive value

@query("purchase_interval_churn", "SELECT * FROM churn_days",
       doubles="total_spend avg_order_value avg_interpurchase", texts="first_purchase last_purchase")
def _(spark, sf):
    return cohort.purchase_interval_churn(b.retail(spark, sf))


@query("churn_rate", "SELECT count(*) AS n_customers, avg(CASE WHEN is_churned THEN 1 ELSE 0 END) AS churn_rate FROM churn_days", doubles="churn_rate")
def _(spark, sf):
    return cohort.churn_rate(cohort.purchase_interval_churn(b.retail(spark, sf)))


@query("aggregate_clv", """
SELECT v AS avg_purchase_value, f AS avg_frequency_year, c AS churn_rate, v * f * 3 AS clv_lifetime, v * f * 3 * 0.15 AS clv_lifetime_profit,
       v * f / (c + 0.0001) AS clv_churn, v * f / (c + 0.0001) * 0.15 AS clv_churn_profit
FROM (SELECT avg(avg_order_value) AS v, avg(n_orders / years) AS f, avg(CASE WHEN is_churned THEN 1.0e0 ELSE 0 END) AS c FROM churn_days, observed)""",
       doubles="avg_purchase_value avg_frequency_year churn_rate clv_lifetime clv_lifetime_profit clv_churn clv_churn_profit")
def _(spark, sf):
    return cohort.aggregate_clv(b.retail(spark, sf))


@query("cohort_clv", """
SELECT strftime(first_purchase, '%Y-%m') AS cohort, count(*) AS cohort_size, avg(avg_order_value) AS avg_order_value, avg(n_orders) AS avg_orders,
       avg(total_spend) AS avg_total_spend, avg(CASE WHEN is_churned THEN 1 ELSE 0 END) AS churn_rate,
       avg(avg_order_value) * (avg(n_orders) / any_value(years)) * 3 * 0.15 AS clv_lifetime
FROM churn_days, observed GROUP BY 1 ORDER BY 1""", doubles="avg_order_value avg_orders avg_total_spend churn_rate clv_lifetime")
def _(spark, sf):
    return cohort.cohort_clv(b.retail(spark, sf))


# ---- features and targets

def _split(spark, sf):
    tx = b.retail(spark, sf)
    history, future = clean.temporal_split(tx)
    return history, future, minus_days(clean.snapshot_of(tx), 90)


@query("features_base", """
SELECT customer_id, frequency, sales_value_sum, sales_value_avg, quantity_avg, recency FROM features""",
       doubles="sales_value_sum sales_value_avg quantity_avg")
def _(spark, sf):
    history, _, t0 = _split(spark, sf)
    return features.features_base(history, t0)


@query("features_rolling", """
SELECT customer_id, txn_last_28d, spend_last_28d, txn_last_14d, spend_last_14d FROM features WHERE txn_last_28d > 0""",
       doubles="spend_last_28d spend_last_14d")
def _(spark, sf):
    history, _, t0 = _split(spark, sf)
    return features.features_rolling(history, t0)


@query("features_diversity", "SELECT customer_id, n_unique_products, n_unique_desc FROM features")
def _(spark, sf):
    return features.features_diversity(_split(spark, sf)[0])


@query("left_join_features_fill0", "SELECT * FROM features",
       doubles="sales_value_sum sales_value_avg quantity_avg spend_last_28d spend_last_14d")
def _(spark, sf):
    history, _, t0 = _split(spark, sf)
    return features.left_join_features_fill0(history, t0)


@query("targets_90d", "SELECT * FROM targets", doubles="sales_90_value")
def _(spark, sf):
    return features.targets_90d(_split(spark, sf)[1])


@query("left_join_labels", "SELECT customer_id, frequency, recency, sales_90_value, purchased_flag FROM model_table", doubles="sales_90_value")
def _(spark, sf):
    history, future, t0 = _split(spark, sf)
    return features.left_join_labels(features.features_base(history, t0), features.targets_90d(future)).select(
        "customer_id", "frequency", "recency", "sales_90_value", "purchased_flag")


@query("target_profile", """
SELECT count(*) AS n_customers, CAST(sum(purchased_flag) AS BIGINT) AS n_purchasers, avg(purchased_flag) * 100 AS purchaser_pct,
       count(*) FILTER (sales_90_value = 0) AS n_zero, avg(CASE WHEN sales_90_value = 0 THEN 1 ELSE 0 END) * 100 AS zero_pct,
       avg(sales_90_value) AS mean_spend, stddev_samp(sales_90_value) AS std_spend, skewness(sales_90_value) AS skewness FROM model_table""",
       doubles="purchaser_pct zero_pct mean_spend std_spend skewness")
def _(spark, sf):
    history, future, t0 = _split(spark, sf)
    return features.target_profile(features.left_join_labels(
        features.features_base(history, t0), features.targets_90d(future)))
