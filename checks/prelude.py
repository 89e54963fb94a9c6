"""SQL common table expressions shared by the oracle queries.

``with_tables(sql)`` prepends exactly the expressions a query refers to.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["raw_tx"] = """
SELECT CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS customer_id,
       (CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(o_orderkey AS VARCHAR) AS invoice,
       CAST(l_partkey AS VARCHAR) AS stock_code, p_name AS description,
       l_quantity * (CASE WHEN l_partkey % 101 = 0 THEN -1 WHEN o_custkey % 40 = 0 THEN 20 ELSE 1 END) AS quantity,
       o_orderdate AS invoice_ts,
       CASE WHEN l_partkey % 103 = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / l_quantity END AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""

CTES["clean_tx"] = """
SELECT CAST(CAST(customer_id AS BIGINT) AS VARCHAR) AS customer_id, invoice, stock_code, description,
       quantity, invoice_ts, price, quantity * price AS order_value
FROM raw_tx WHERE customer_id IS NOT NULL AND NOT starts_with(invoice, 'C') AND quantity > 0 AND price > 0"""

CTES["buyer"] = """
SELECT customer_id, avg(order_value) AS avg_order_value, avg(quantity) AS avg_quantity,
       sum(order_value) AS total_spend, count(*) AS n_lines FROM clean_tx GROUP BY customer_id"""

CTES["bulk_limits"] = """
SELECT quantile_cont(avg_order_value, 0.75) + 3 * (quantile_cont(avg_order_value, 0.75) - quantile_cont(avg_order_value, 0.25)) AS value_threshold,
       quantile_cont(avg_quantity, 0.75) + 3 * (quantile_cont(avg_quantity, 0.75) - quantile_cont(avg_quantity, 0.25)) AS quantity_threshold
FROM buyer"""

CTES["buyer_flag"] = """
SELECT b.*, l.*, (avg_order_value > value_threshold OR avg_quantity > quantity_threshold) AS is_wholesale
FROM buyer b, bulk_limits l"""

CTES["retail"] = """
SELECT * FROM clean_tx WHERE customer_id NOT IN (SELECT customer_id FROM buyer_flag WHERE is_wholesale)"""

CTES["rfm_base"] = """
SELECT customer_id, count(DISTINCT invoice) AS frequency, avg(order_value) AS monetary, sum(order_value) AS total_spend,
       count(DISTINCT invoice) AS n_orders,
       CAST(floor((epoch_us((SELECT max(invoice_ts) FROM retail)) - epoch_us(max(invoice_ts))) / 86400000000.0) AS BIGINT) AS recency
FROM retail GROUP BY customer_id"""

CTES["rfm_rank"] = """
SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS f_no, row_number() OVER (ORDER BY monetary, customer_id) AS m_no,
       count(*) OVER () AS n FROM rfm_base"""

CTES["recency_edges"] = """
SELECT quantile_cont(CAST(recency AS DOUBLE), 0.2) AS e1, quantile_cont(CAST(recency AS DOUBLE), 0.4) AS e2,
       quantile_cont(CAST(recency AS DOUBLE), 0.6) AS e3, quantile_cont(CAST(recency AS DOUBLE), 0.8) AS e4 FROM rfm_base"""

CTES["rfm_points"] = """
SELECT customer_id, frequency, monetary, total_spend, n_orders, recency,
       CAST(greatest(1, (5 * (f_no - 1) + n - 2) // (n - 1)) AS INTEGER) AS f_score,
       CAST(greatest(1, (5 * (m_no - 1) + n - 2) // (n - 1)) AS INTEGER) AS m_score,
       CASE WHEN recency <= e1 THEN 5 WHEN recency <= e2 THEN 4 WHEN recency <= e3 THEN 3 WHEN recency <= e4 THEN 2 ELSE 1 END AS r_score
FROM rfm_rank, recency_edges"""

CTES["customers"] = """
SELECT *, r_score + f_score + m_score AS rfm_score,
       CASE WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN 'Cannot Lose Them'
            WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 3 THEN 'Champions'
            WHEN f_score >= 4 AND r_score >= 3 THEN 'Loyal Customers'
            WHEN r_score >= 3 AND f_score = 3 THEN 'Potential Loyalists'
            WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers'
            WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk'
            WHEN r_score <= 2 AND f_score <= 2 THEN 'Hibernating'
            ELSE 'Need Attention' END AS segment
FROM rfm_points"""

CTES["star_orders"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       CASE WHEN o_orderstatus = 'F' THEN 'delivered' ELSE 'open' END AS order_status,
       CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS order_purchase_timestamp,
       CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') END AS order_delivered_customer_date
FROM orders"""

CTES["star_items"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, sum(l_extendedprice) AS revenue, count(l_linenumber) AS n_items
FROM lineitem GROUP BY 1"""

CTES["star_payments"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS payment_value
FROM lineitem GROUP BY 1"""

CTES["star_customers"] = """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_unique_id, n_name AS customer_state
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

CTES["star"] = """
SELECT o.*, i.revenue, i.n_items, p.payment_value, c.customer_unique_id, c.customer_state
FROM star_orders o LEFT JOIN star_items i USING (order_id) LEFT JOIN star_payments p USING (order_id)
LEFT JOIN star_customers c USING (customer_id)"""

CTES["star_done"] = """
SELECT * REPLACE (try_cast(order_purchase_timestamp AS TIMESTAMP) AS order_purchase_timestamp,
                  try_cast(order_delivered_customer_date AS TIMESTAMP) AS order_delivered_customer_date)
FROM star WHERE order_status = 'delivered' AND revenue > 0 AND customer_unique_id IS NOT NULL
  AND try_cast(order_purchase_timestamp AS TIMESTAMP) IS NOT NULL"""

CTES["rfm_orders"] = """
SELECT customer_unique_id, count(DISTINCT order_id) AS frequency, avg(revenue) AS monetary,
       CAST(floor((epoch_us((SELECT max(order_purchase_timestamp) FROM star_done)) + 86400000000 - epoch_us(max(order_purchase_timestamp))) / 86400000000.0) AS BIGINT) AS recency
FROM star_done GROUP BY customer_unique_id"""

CTES["rfm_thirds"] = """
SELECT *, r_score + f_score + m_score AS rfm_score,
       CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_label
FROM (SELECT r.*, CASE WHEN recency <= r1 THEN 3 WHEN recency <= r2 THEN 2 ELSE 1 END AS r_score,
             CASE WHEN frequency <= f1 THEN 1 WHEN frequency <= f2 THEN 2 ELSE 3 END AS f_score,
             CASE WHEN monetary <= m1 THEN 1 WHEN monetary <= m2 THEN 2 ELSE 3 END AS m_score
      FROM rfm_orders r,
           (SELECT quantile_cont(CAST(recency AS DOUBLE), 0.33) AS r1, quantile_cont(CAST(recency AS DOUBLE), 0.66) AS r2,
                   quantile_cont(CAST(frequency AS DOUBLE), 0.33) AS f1, quantile_cont(CAST(frequency AS DOUBLE), 0.66) AS f2,
                   quantile_cont(monetary, 0.33) AS m1, quantile_cont(monetary, 0.66) AS m2 FROM rfm_orders) q)"""

CTES["salaries"] = """
SELECT 'T' || CAST(o_orderkey % 25 AS VARCHAR) AS team_id, o_custkey AS player_id, CAST(year(o_orderdate) AS INTEGER) AS year,
       sum(o_totalprice) AS salary FROM orders GROUP BY 1, 2, 3"""

CTES["players"] = """
SELECT c_custkey AS player_id, c_name AS name, 1960 + c_custkey % 31 AS birth_year, 1 + c_custkey % 12 AS birth_month,
       1 + c_custkey % 31 AS birth_day, debut, final_game,
       CASE c_custkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'L' WHEN 2 THEN 'B' END AS bats,
       60 + c_custkey % 20 AS height, 150 + c_custkey % 80 AS weight
FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS debut, CAST(max(o_orderdate) AS DATE) AS final_game
                         FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""

CTES["born"] = """
SELECT *, try_cast(birth_year || '-' || lpad(CAST(birth_month AS VARCHAR), 2, '0') || '-' || lpad(CAST(birth_day AS VARCHAR), 2, '0') AS DATE) AS birthdate
FROM players"""

CTES["schools"] = """
SELECT o_custkey AS player_id, l_suppkey AS school_id, CAST(year(l_shipdate) AS INTEGER) AS year
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

CTES["school_details"] = "SELECT s_suppkey AS school_id, s_name AS name FROM supplier WHERE s_suppkey % 10 <> 0"

CTES["team_year"] = "SELECT team_id, year, sum(salary) AS total_spend FROM salaries GROUP BY 1, 2"

CTES["span"] = """
SELECT p.player_id, p.name, s.year AS starting_year, s.team_id AS starting_team, e.year AS ending_year, e.team_id AS ending_team
FROM players p JOIN salaries s ON p.player_id = s.player_id AND year(p.debut) = s.year
JOIN salaries e ON p.player_id = e.player_id AND year(p.final_game) = e.year"""

CTES["churn_days"] = """
SELECT customer_id, first_purchase, last_purchase, n_orders, total_spend, avg_order_value, days_since_last, observation_days,
       avg_interpurchase, days_since_last > 2 * avg_interpurchase AS is_churned
FROM (SELECT *, CASE WHEN n_orders > 1 THEN CAST(observation_days AS DOUBLE) / (n_orders - 1) ELSE CAST(total_days AS DOUBLE) END AS avg_interpurchase
      FROM (SELECT c.*, CAST(floor((epoch_us(hi) - epoch_us(last_purchase)) / 86400000000.0) AS BIGINT) AS days_since_last,
                   CAST(floor((epoch_us(last_purchase) - epoch_us(first_purchase)) / 86400000000.0) AS BIGINT) AS observation_days,
                   CAST(floor((epoch_us(hi) - epoch_us(lo)) / 86400000000.0) AS BIGINT) AS total_days
            FROM (SELECT customer_id, min(invoice_ts) AS first_purchase, max(invoice_ts) AS last_purchase,
                         count(DISTINCT invoice) AS n_orders, sum(order_value) AS total_spend, avg(order_value) AS avg_order_value
                  FROM retail GROUP BY customer_id) c,
                 (SELECT min(invoice_ts) AS lo, max(invoice_ts) AS hi FROM retail) s))"""

CTES["observed"] = """
SELECT floor((epoch_us(max(invoice_ts)) - epoch_us(min(invoice_ts))) / 86400000000.0) / 365 AS years FROM retail"""

CTES["cutoff"] = "SELECT max(invoice_ts) - INTERVAL 90 DAY AS t0 FROM retail"

CTES["history"] = "SELECT r.*, t0 FROM retail r, cutoff WHERE invoice_ts <= t0"

CTES["future"] = "SELECT r.* FROM retail r, cutoff WHERE invoice_ts > t0"

CTES["features"] = """
SELECT customer_id, count(DISTINCT invoice) AS frequency, sum(order_value) AS sales_value_sum, avg(order_value) AS sales_value_avg,
       avg(quantity) AS quantity_avg,
       CAST(floor((epoch_us(any_value(t0)) - epoch_us(max(invoice_ts))) / 86400000000.0) AS BIGINT) AS recency,
       count(DISTINCT invoice) FILTER (invoice_ts >= t0 - INTERVAL 28 DAY) AS txn_last_28d,
       coalesce(sum(order_value) FILTER (invoice_ts >= t0 - INTERVAL 28 DAY), 0) AS spend_last_28d,
       count(DISTINCT invoice) FILTER (invoice_ts >= t0 - INTERVAL 14 DAY) AS txn_last_14d,
       coalesce(sum(order_value) FILTER (invoice_ts >= t0 - INTERVAL 14 DAY), 0) AS spend_last_14d,
       count(DISTINCT stock_code) AS n_unique_products, count(DISTINCT description) AS n_unique_desc
FROM history GROUP BY customer_id"""

CTES["targets"] = "SELECT customer_id, sum(order_value) AS sales_90_value, 1 AS purchased_flag FROM future GROUP BY customer_id"

CTES["model_table"] = """
SELECT f.*, coalesce(t.sales_90_value, 0) AS sales_90_value, coalesce(t.purchased_flag, 0) AS purchased_flag
FROM features f LEFT JOIN targets t USING (customer_id)"""

CTES["subscribers"] = """
SELECT c_custkey AS subscriber_key, n_name AS state, CAST(c_nationkey AS VARCHAR) AS area_code, c_name AS phone_number,
       CAST(date_diff('day', first_day, last_day) AS INTEGER) AS account_length,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'yes' ELSE 'no' END AS international_plan,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Yes' ELSE 'no' END AS voice_mail_plan,
       total_day_minutes, total_day_charge, total_eve_minutes, total_eve_charge,
       total_night_minutes, total_night_charge, total_intl_minutes, total_intl_charge,
       number_customer_service_calls,
       CASE WHEN last_day <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY THEN 'yes' ELSE 'no' END AS churn
FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN (SELECT o_custkey, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS INTEGER) AS number_customer_service_calls,
             min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1) k ON c_custkey = k.o_custkey
JOIN (SELECT o_custkey,
             coalesce(sum(l_quantity) FILTER (l_linenumber % 4 = 0), 0) AS total_day_minutes,
             coalesce(sum(l_extendedprice) FILTER (l_linenumber % 4 = 0), 0) AS total_day_charge,
             coalesce(sum(l_quantity) FILTER (l_linenumber % 4 = 1), 0) AS total_eve_minutes,
             coalesce(sum(l_extendedprice) FILTER (l_linenumber % 4 = 1), 0) AS total_eve_charge,
             coalesce(sum(l_quantity) FILTER (l_linenumber % 4 = 2), 0) AS total_night_minutes,
             coalesce(sum(l_extendedprice) FILTER (l_linenumber % 4 = 2), 0) AS total_night_charge,
             coalesce(sum(l_quantity) FILTER (l_linenumber % 4 = 3), 0) AS total_intl_minutes,
             coalesce(sum(l_extendedprice) FILTER (l_linenumber % 4 = 3), 0) AS total_intl_charge
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) u ON c_custkey = u.o_custkey"""

CTES["scores"] = """
SELECT subscriber_key, state, label, 0.6e0 * (((subscriber_key * 2654435761) % 1000) / 1000.0e0) + 0.4e0 * label AS score,
       total_day_charge, total_eve_charge, total_night_charge, total_intl_charge,
       international_plan, number_customer_service_calls, total_day_minutes, voice_mail_plan
FROM (SELECT *, CASE WHEN churn = 'yes' THEN 1 ELSE 0 END AS label FROM subscribers)"""


# Parameters at which the closed-form scores are compared.
BGNBD = {"r": 0.69, "alpha": 67.25, "a": 0.045, "b": 0.59}
GAMMA = {"p": 2.0, "q": 3.5, "v": 60000.0}
_R, _AL, _A, _B = (f"{BGNBD[k]}e0" for k in ("r", "alpha", "a", "b"))
_P, _Q, _V = (f"{GAMMA[k]}e0" for k in ("p", "q", "v"))

CTES["btyd"] = """
SELECT customer_id, count(*) - 1 AS x, CAST(date_diff('day', min(day), max(day)) AS INTEGER) AS t_x,
       CAST(date_diff('day', min(day), (SELECT CAST(max(invoice_ts) AS DATE) FROM retail)) AS INTEGER) AS "T",
       CASE WHEN count(*) > 1 THEN (sum(v) - arg_min(v, day)) / (count(*) - 1) ELSE 0 END AS m
FROM (SELECT customer_id, CAST(invoice_ts AS DATE) AS day, sum(order_value) AS v FROM retail GROUP BY 1, 2) GROUP BY customer_id"""

CTES["lapse"] = f"""
SELECT *, CASE WHEN x > 0 THEN {_A} / ({_B} + x - 1) * pow(({_AL} + "T") / ({_AL} + t_x), {_R} + x) ELSE 0 END AS odds FROM btyd"""

# Gauss series by log-gamma; for x = 0 the third parameter is negative, which flips the sign after the first term
CTES["series"] = f"""
SELECT customer_id, d, sum(CASE WHEN {_A} + {_B} + x - 1 < 0 AND k >= 1 THEN -1 ELSE 1 END * exp(
         lgamma({_R} + x + k) - lgamma({_R} + x) + lgamma({_B} + x + k) - lgamma({_B} + x)
         - lgamma({_A} + {_B} + x - 1 + k) + lgamma({_A} + {_B} + x - 1) - lgamma(k + 1) + k * ln(d / ({_AL} + "T" + d)))) AS h
FROM btyd, (SELECT CAST(unnest(generate_series(30, 360, 30)) AS DOUBLE) AS d) AS days,
     (SELECT CAST(unnest(generate_series(0, 600)) AS DOUBLE) AS k) AS terms
GROUP BY customer_id, d"""

CTES["ey"] = f"""
SELECT l.*, s.d, ({_A} + {_B} + x - 1) / ({_A} - 1) * (1 - pow(({_AL} + "T") / ({_AL} + "T" + d), {_R} + x) * h) / (1 + odds) AS e
FROM lapse l JOIN series s USING (customer_id)"""

CTES["spend_rate"] = f"SELECT customer_id, x, m, {_P} * ({_V} + x * m) / ({_P} * x + {_Q} - 1) AS expected_spend FROM btyd"

CTES["clv"] = """
SELECT customer_id, any_value(expected_spend) * sum(gain) FILTER (d <= 90) AS clv_90d, any_value(expected_spend) * sum(gain) AS clv_12m,
       any_value(1 / (1 + odds)) AS prob_alive
FROM (SELECT e.customer_id, d, odds, expected_spend,
             (e - coalesce(lag(e) OVER (PARTITION BY e.customer_id ORDER BY d), 0)) / pow(1.01e0, d / 30) AS gain
      FROM ey e JOIN spend_rate r ON e.customer_id = r.customer_id WHERE e.x > 0 AND e.m > 0) GROUP BY customer_id"""

CTES["valued"] = """
SELECT c.*, v.clv_90d, v.clv_12m, v.prob_alive, pred_spend, pred_prob, pred_spend * pred_prob AS pred_clv_90d
FROM customers c LEFT JOIN clv v USING (customer_id)
LEFT JOIN (SELECT customer_id, 0.9e0 * sales_value_sum / (1 + frequency) AS pred_spend, 1 / (1 + recency / 90.0e0) AS pred_prob FROM features) f USING (customer_id)"""

CTES["pairs"] = """
SELECT CAST(customer_id AS BIGINT) AS customer_key, (recency - (SELECT avg(recency) FROM rfm_base)) / (SELECT stddev_pop(recency) FROM rfm_base) AS z_recency,
       (frequency - (SELECT avg(frequency) FROM rfm_base)) / (SELECT stddev_pop(frequency) FROM rfm_base) AS z_frequency,
       (monetary - (SELECT avg(monetary) FROM rfm_base)) / (SELECT stddev_pop(monetary) FROM rfm_base) AS z_monetary,
       CAST((recency > (SELECT median(recency) FROM rfm_base)) AS INTEGER) * 2
         + CAST((frequency > (SELECT median(frequency) FROM rfm_base)) AS INTEGER) AS cluster
FROM rfm_base"""

CTES["neighbors"] = """
SELECT customer_key, kth_distance FROM (
  SELECT p.customer_key, sqrt(pow(p.z_recency - o.z_recency, 2) + pow(p.z_frequency - o.z_frequency, 2) + pow(p.z_monetary - o.z_monetary, 2)) AS kth_distance,
         row_number() OVER (PARTITION BY p.customer_key ORDER BY pow(p.z_recency - o.z_recency, 2) + pow(p.z_frequency - o.z_frequency, 2) + pow(p.z_monetary - o.z_monetary, 2)) AS place
  FROM pairs p, pairs o) WHERE place = 5"""


def with_tables(sql: str) -> str:
    """Prepend the shared expressions that ``sql`` needs, in definition order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(body)
    if not needed:
        return sql
    # an expression may rest on one defined after it, so order by dependency
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for other in needed:
            if other != name and re.search(rf"\b{other}\b", CTES[name]):
                place(other)
        ordered.append(name)

    for name in CTES:
        if name in needed:
            place(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + sql
