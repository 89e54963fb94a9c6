"""Scans, cleaning, joins, aggregations and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as b
from checks.registry import query
from ledgerlens.functions.scalars import birth_date, round_doubles
from ledgerlens.operators import clean, distribution, orders, seasons, wholesale
from ledgerlens.sources import artifacts, schemas, tables


# ---- scans, sinks and schema checks

@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", doubles="c_acctbal")
def _(spark, sf):
    source = b.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = b.scratch(spark, "csv")
    tables.sink_table(source, path, "csv")
    return tables.scan_csv(spark, path, source.schema)


@query("scan_union_parts", "SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def _(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    first = tables.scan_union_parts([o.where("year <= 1997")])
    return tables.scan_union_parts([first, o.where("year > 1997").select("year", "o_custkey", "o_orderkey")])


@query("validate_schema", "SELECT count(*) AS n_rows, 'stock_code' AS rejected FROM raw_tx")
def _(spark, sf):
    tx = b.transactions(spark, sf)
    checked = tables.validate_schema(tx, schemas.TRANSACTION_COLUMNS)
    try:
        tables.validate_schema(tx.drop("stock_code"), schemas.TRANSACTION_COLUMNS)
        rejected = None
    except ValueError as error:
        rejected = str(error).rsplit(" ", 1)[-1]
    return checked.agg(F.count("*").alias("n_rows"), F.lit(rejected).alias("rejected"))


@query("normalize_headers", """
SELECT state, international_plan AS international_plan, number_customer_service_calls AS customer_service_calls FROM subscribers""")
def _(spark, sf):
    titled = b.subscribers(spark, sf).select(
        F.col("state").alias(" State"), F.col("international_plan").alias("International Plan"),
        F.col("number_customer_service_calls").alias("Customer service calls "))
    return tables.normalize_headers(titled)


_PROFILED = ("quantity", "price", "order_value")


@query("profile_table", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
       quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max
FROM clean_tx""" for c in _PROFILED), doubles="mean std min p25 p50 p75 max")
def _(spark, sf):
    return tables.profile_table(b.cleaned(spark, sf), _PROFILED)


@query("sink_table", "SELECT team_id, year, total_spend FROM team_year", doubles="total_spend")
def _(spark, sf):
    path = b.scratch(spark, "sink")
    tables.sink_table(seasons.team_year_spend(b.salaries(spark, sf)), path, partition_by=["year"])
    return spark.read.parquet(path).select("team_id", "year", "total_spend")


_EARLY = "FROM (SELECT customer_id, max(invoice_ts) AS last_purchase, sum(order_value) AS total_spend FROM clean_tx"


@query("append_scored", f"""
SELECT coalesce(n.customer_id, o.customer_id) AS customer_id, coalesce(n.total_spend, o.total_spend) AS total_spend,
       CASE WHEN n.customer_id IS NULL THEN 1 ELSE 2 END AS batch_ts
FROM (SELECT * {_EARLY} WHERE year(invoice_ts) < 2000 GROUP BY 1)) o
FULL JOIN (SELECT * {_EARLY} WHERE year(invoice_ts) >= 2000 GROUP BY 1)) n ON o.customer_id = n.customer_id""",
       doubles="total_spend")
def _(spark, sf):
    tx = b.cleaned(spark, sf)

    def batch(rows, number):
        return rows.groupBy("customer_id").agg(F.sum("order_value").alias("total_spend")).withColumn("batch_ts", F.lit(number))

    return artifacts.append_scored(batch(tx.where(F.year("invoice_ts") < 2000), 1), batch(tx.where(F.year("invoice_ts") >= 2000), 2))


# ---- projections, filters, cleaning

@query("clean_transactions", "SELECT customer_id, invoice, stock_code, quantity, price, order_value, invoice_ts FROM clean_tx",
       doubles="quantity price order_value", texts="invoice_ts")
def _(spark, sf):
    return b.cleaned(spark, sf).drop("description")


@query("cleaning_audit", """
WITH c AS (SELECT count(*) AS n0, count(*) FILTER (customer_id IS NOT NULL) AS n1,
                  count(*) FILTER (customer_id IS NOT NULL AND NOT starts_with(invoice, 'C')) AS n2,
                  count(*) FILTER (customer_id IS NOT NULL AND NOT starts_with(invoice, 'C') AND quantity > 0 AND price > 0) AS n3 FROM raw_tx)
SELECT 1 AS step, 'missing customer' AS rule, n0 AS rows_in, n0 - n1 AS removed, round((n0 - n1) / n0 * 100.0e0, 1) AS removed_pct FROM c
UNION ALL SELECT 2, 'return invoice', n1, n1 - n2, round((n1 - n2) / n1 * 100.0e0, 1) FROM c
UNION ALL SELECT 3, 'non-positive quantity or price', n2, n2 - n3, round((n2 - n3) / n2 * 100.0e0, 1) FROM c""", doubles="removed_pct")
def _(spark, sf):
    return clean.cleaning_audit(b.transactions(spark, sf))


def _star(spark, sf):
    return orders.star_merge_orders(
        b.orders(spark, sf), b.order_customers(spark, sf), b.order_items(spark, sf), b.payments(spark, sf))


def _parsed(spark, sf):
    return clean.parse_dates_lenient(
        _star(spark, sf), ["order_purchase_timestamp", "order_delivered_customer_date"], "yyyy-MM-dd HH:mm:ss")


def _completed(spark, sf):
    return clean.filter_completed_orders(_parsed(spark, sf))


@query("filter_completed_orders",
       "SELECT order_id, customer_unique_id, revenue, n_items, order_purchase_timestamp FROM star_done",
       doubles="revenue", texts="order_purchase_timestamp")
def _(spark, sf):
    return _completed(spark, sf).select("order_id", "customer_unique_id", "revenue", "n_items", "order_purchase_timestamp")


@query("parse_dates_lenient", """
SELECT order_id, try_cast(order_purchase_timestamp AS TIMESTAMP) AS order_purchase_timestamp FROM star_orders""",
       texts="order_purchase_timestamp")
def _(spark, sf):
    return clean.parse_dates_lenient(
        b.orders(spark, sf).select("order_id", "order_purchase_timestamp"), ["order_purchase_timestamp"], "yyyy-MM-dd HH:mm:ss")


@query("normalize_customer_key", """
SELECT CAST(CAST(customer_id AS BIGINT) AS VARCHAR) AS customer_id, count(*) AS n FROM raw_tx GROUP BY 1""")
def _(spark, sf):
    return clean.normalize_customer_key(b.transactions(spark, sf)).groupBy("customer_id").agg(F.count("*").alias("n"))


@query("map_binary", """
SELECT subscriber_key, CASE lower(international_plan) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS international_plan,
       CASE lower(voice_mail_plan) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS voice_mail_plan FROM subscribers""")
def _(spark, sf):
    return clean.map_binary(b.subscribers(spark, sf).select("subscriber_key", "international_plan", "voice_mail_plan"),
                            ["international_plan", "voice_mail_plan"])


@query("drop_identifiers", "SELECT subscriber_key, account_length, churn FROM subscribers")
def _(spark, sf):
    slim = b.subscribers(spark, sf).select("subscriber_key", "state", "area_code", "account_length", "churn")
    return clean.drop_identifiers(slim)


@query("temporal_split", """
SELECT 'history' AS part, count(*) AS n_lines, count(DISTINCT customer_id) AS n_customers, max(invoice_ts) AS last_ts FROM history
UNION ALL SELECT 'future', count(*), count(DISTINCT customer_id), max(invoice_ts) FROM future""", texts="last_ts")
def _(spark, sf):
    history, future = clean.temporal_split(b.retail(spark, sf))
    parts = [p.agg(F.lit(n).alias("part"), F.count("*").alias("n_lines"), F.count_distinct("customer_id").alias("n_customers"),
                   F.max("invoice_ts").alias("last_ts")) for n, p in (("history", history), ("future", future))]
    return tables.scan_union_parts(parts)


@query("filter_in_list", """
SELECT customer_id, segment, rfm_score FROM customers WHERE segment IN ('At Risk', 'Cannot Lose Them')""")
def _(spark, sf):
    return clean.filter_in_list(b.rfm_scored(spark, sf), "segment", ["At Risk", "Cannot Lose Them"]).select(
        "customer_id", "segment", "rfm_score")


@query("between_year_filter", "SELECT player_id, birthdate FROM born WHERE year(birthdate) BETWEEN 1980 AND 1990", texts="birthdate")
def _(spark, sf):
    born = b.players(spark, sf).select("player_id", birth_date("birth_year", "birth_month", "birth_day").alias("birthdate"))
    return clean.between_year_filter(born, "birthdate", 1980, 1990)


@query("round_floats", """
SELECT invoice, stock_code, quantity, CAST(round(CAST(CAST(price AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) AS price FROM clean_tx""",
       doubles="quantity price")
def _(spark, sf):
    return round_doubles(b.cleaned(spark, sf).select("invoice", "stock_code", "quantity", "price"))


@query("id_generator", """
SELECT subscriber_key, 'CUST-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS customer_id
FROM (SELECT subscriber_key, row_number() OVER (ORDER BY subscriber_key) AS n FROM subscribers)""")
def _(spark, sf):
    return clean.id_generator(b.subscribers(spark, sf).select("subscriber_key"), ["subscriber_key"])


# ---- joins

@query("left_join_dimension", """
SELECT school_id, player_id, year, name FROM schools LEFT JOIN school_details USING (school_id)""")
def _(spark, sf):
    return seasons.left_join_dimension(b.schools(spark, sf), b.school_details(spark, sf))


@query("join_first_last_season", "SELECT * FROM span")
def _(spark, sf):
    return seasons.join_first_last_season(b.players(spark, sf), b.salaries(spark, sf))


@query("same_start_end_team", "SELECT * FROM span WHERE starting_team = ending_team AND ending_year - starting_year > 4")
def _(spark, sf):
    return seasons.same_start_end_team(b.players(spark, sf), b.salaries(spark, sf), longer_than=4)


@query("star_merge_orders", """
SELECT order_id, customer_id, order_status, revenue, n_items, payment_value, customer_unique_id, customer_state FROM star""",
       doubles="revenue payment_value")
def _(spark, sf):
    return _star(spark, sf).drop("order_purchase_timestamp", "order_delivered_customer_date")


@query("semi_join_keyset", """
SELECT customer_id, invoice, stock_code, order_value FROM clean_tx
WHERE customer_id IN (SELECT customer_id FROM buyer_flag WHERE is_wholesale)""", doubles="order_value")
def _(spark, sf):
    tx = b.cleaned(spark, sf)
    return wholesale.semi_join_keyset(tx, wholesale.flag_wholesale(tx).where("is_wholesale")).select(
        "customer_id", "invoice", "stock_code", "order_value")


@query("anti_join_keyset", """
SELECT customer_id, count(*) AS n_lines, sum(order_value) AS spend FROM retail GROUP BY 1""", doubles="spend")
def _(spark, sf):
    tx = b.cleaned(spark, sf)
    rest = wholesale.anti_join_keyset(tx, wholesale.flag_wholesale(tx).where("is_wholesale"))
    return rest.groupBy("customer_id").agg(F.count("*").alias("n_lines"), F.sum("order_value").alias("spend"))


# ---- aggregations

@query("distinct_by_decade", """
SELECT CAST(year // 10 * 10 AS INTEGER) AS decade, count(DISTINCT school_id) AS num_schools FROM schools GROUP BY 1 ORDER BY 1""")
def _(spark, sf):
    return seasons.distinct_by_decade(b.schools(spark, sf))


@query("top_schools", """
SELECT school_id, name, num_players FROM (SELECT school_id, count(DISTINCT player_id) AS num_players FROM schools GROUP BY 1)
LEFT JOIN school_details USING (school_id) ORDER BY num_players DESC, school_id LIMIT 5""")
def _(spark, sf):
    return seasons.top_schools(b.schools(spark, sf), b.school_details(spark, sf))


@query("team_year_spend", "SELECT team_id, year, total_spend FROM team_year", doubles="total_spend")
def _(spark, sf):
    return seasons.team_year_spend(b.salaries(spark, sf))


@query("avg_annual_spend", "SELECT team_id, avg(total_spend) AS avg_spend FROM team_year GROUP BY 1", doubles="avg_spend")
def _(spark, sf):
    return seasons.avg_annual_spend(b.salaries(spark, sf))


@query("pivot_share", """
SELECT team_id, round(count(*) FILTER (bats = 'R') / count(player_id) * 100, 1) AS bats_right,
       round(count(*) FILTER (bats = 'L') / count(player_id) * 100, 1) AS bats_left,
       round(count(*) FILTER (bats = 'B') / count(player_id) * 100, 1) AS bats_both
FROM (SELECT DISTINCT s.team_id, s.player_id, p.bats FROM salaries s LEFT JOIN players p ON s.player_id = p.player_id) GROUP BY team_id""",
       doubles="bats_right bats_left bats_both")
def _(spark, sf):
    return seasons.pivot_share(b.players(spark, sf), b.salaries(spark, sf))


@query("select_distinct", """
SELECT DISTINCT s.team_id, s.player_id, p.bats FROM salaries s LEFT JOIN players p ON s.player_id = p.player_id""")
def _(spark, sf):
    return seasons.select_distinct(b.players(spark, sf), b.salaries(spark, sf))


@query("group_concat", """
SELECT birthdate, string_agg(name, ', ' ORDER BY name) AS players FROM born
WHERE year(birthdate) BETWEEN 1980 AND 1990 GROUP BY 1 ORDER BY 1""", texts="birthdate")
def _(spark, sf):
    return seasons.group_concat(b.players(spark, sf))


@query("order_preaggregate", "SELECT order_id, revenue, n_items FROM star_items", doubles="revenue")
def _(spark, sf):
    return orders.order_preaggregate(b.order_items(spark, sf))


@query("key_uniqueness", """
SELECT 'payments' AS relation, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_distinct, count(*) = count(DISTINCT l_orderkey) AS is_unique FROM lineitem
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), count(*) = count(DISTINCT o_orderkey) FROM orders""")
def _(spark, sf):
    parts = [tables.key_uniqueness(df, "order_id").withColumn("relation", F.lit(n))
             for n, df in (("payments", b.payments(spark, sf)), ("orders", b.orders(spark, sf)))]
    return tables.scan_union_parts(parts)


@query("missing_audit", """
SELECT * FROM (SELECT unnest(['customer_unique_id', 'n_items', 'order_delivered_customer_date', 'payment_value', 'revenue']) AS "column",
       unnest([count(*) FILTER (customer_unique_id IS NULL), count(*) FILTER (n_items IS NULL),
               count(*) FILTER (order_delivered_customer_date IS NULL), count(*) FILTER (payment_value IS NULL), count(*) FILTER (revenue IS NULL)]) AS missing_count,
       unnest([round(count(*) FILTER (customer_unique_id IS NULL) / count(*) * 100, 2), round(count(*) FILTER (n_items IS NULL) / count(*) * 100, 2),
               round(count(*) FILTER (order_delivered_customer_date IS NULL) / count(*) * 100, 2),
               round(count(*) FILTER (payment_value IS NULL) / count(*) * 100, 2), round(count(*) FILTER (revenue IS NULL) / count(*) * 100, 2)]) AS missing_pct
FROM star) WHERE missing_count > 0""", doubles="missing_pct")
def _(spark, sf):
    return tables.missing_audit(_star(spark, sf))


@query("distribution_stats", """
SELECT avg(order_value) AS mean, median(order_value) AS median, stddev_samp(order_value) AS std, skewness(order_value) AS skewness,
       kurtosis(order_value) AS kurtosis, quantile_cont(order_value, 0.25) AS q1, quantile_cont(order_value, 0.75) AS q3,
       quantile_cont(order_value, 0.75) - quantile_cont(order_value, 0.25) AS iqr,
       quantile_cont(order_value, 0.95) AS p95, quantile_cont(order_value, 0.99) AS p99 FROM retail""",
       doubles="mean median std skewness kurtosis q1 q3 iqr p95 p99")
def _(spark, sf):
    return distribution.distribution_stats(b.retail(spark, sf), "order_value")


@query("skew_by_column", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", s AS skewness,
       CASE WHEN s > 0.5 THEN 'right-skewed' WHEN s < -0.5 THEN 'left-skewed' ELSE 'approximately symmetric' END AS direction
FROM (SELECT skewness({c}) AS s FROM rfm_base)""" for c in ("recency", "frequency", "monetary")), doubles="skewness")
def _(spark, sf):
    return distribution.skew_by_column(b.rfm_base(spark, sf), ["recency", "frequency", "monetary"])


@query("box_stats", """
SELECT churn, q1, median, q3, min(total_day_minutes) FILTER (inside) AS whisker_low, max(total_day_minutes) FILTER (inside) AS whisker_high,
       count(*) FILTER (NOT inside) AS outliers
FROM (SELECT s.churn, total_day_minutes, q1, median, q3,
             total_day_minutes BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM subscribers s JOIN (SELECT churn, quantile_cont(total_day_minutes, 0.25) AS q1, median(total_day_minutes) AS median,
                                      quantile_cont(total_day_minutes, 0.75) AS q3 FROM subscribers GROUP BY churn) q ON s.churn = q.churn)
GROUP BY ALL""", doubles="q1 median q3 whisker_low whisker_high")
def _(spark, sf):
    return distribution.box_stats(b.subscribers(spark, sf), "total_day_minutes", "churn")


@query("histogram", """
SELECT bin, lo + bin * w AS bin_start, count(*) AS n
FROM (SELECT CAST(least(floor((v - lo) / w), 59) AS INTEGER) AS bin, lo, w
      FROM (SELECT ln(1 + order_value) AS v FROM retail),
           (SELECT min(ln(1 + order_value)) AS lo, (max(ln(1 + order_value)) - min(ln(1 + order_value))) / 60 AS w FROM retail))
GROUP BY ALL""", doubles="bin_start")
def _(spark, sf):
    return distribution.histogram(b.retail(spark, sf), F.ln(1 + F.col("order_value")), bins=60)


@query("histogram_by_class", """
SELECT churn, bin, lo + bin * w AS bin_start, count(*) AS n
FROM (SELECT churn, CAST(least(floor((number_customer_service_calls - lo) / w), 9) AS INTEGER) AS bin, lo, w FROM subscribers,
      (SELECT CAST(min(number_customer_service_calls) AS DOUBLE) AS lo,
              (max(number_customer_service_calls) - min(number_customer_service_calls)) / 10.0e0 AS w FROM subscribers))
GROUP BY ALL""", doubles="bin_start")
def _(spark, sf):
    return distribution.histogram(b.subscribers(spark, sf), "number_customer_service_calls", bins=10, by=["churn"])


@query("value_counts", """
SELECT frequency, count(*) AS n, count(*) / (SELECT count(*) FROM rfm_base) * 100 AS pct FROM rfm_base GROUP BY 1 ORDER BY 1""", doubles="pct")
def _(spark, sf):
    return distribution.value_counts(b.rfm_base(spark, sf), "frequency")


@query("monthly_trend", """
SELECT CAST(date_trunc('month', invoice_ts) AS DATE) AS month, count(*) AS n_lines, sum(order_value) AS revenue,
       count(DISTINCT invoice) AS n_orders, count(DISTINCT customer_id) AS n_customers FROM retail GROUP BY 1 ORDER BY 1""",
       doubles="revenue", texts="month")
def _(spark, sf):
    return distribution.monthly_trend(b.retail(spark, sf), "invoice_ts", "order_value", "invoice", "customer_id")


@query("dataset_summary", """
SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, CAST(min(invoice_ts) AS DATE) AS first_date,
       CAST(max(invoice_ts) AS DATE) AS last_date, sum(order_value) AS total_value FROM clean_tx""", doubles="total_value", texts="first_date last_date")
def _(spark, sf):
    return tables.dataset_summary(b.cleaned(spark, sf), "customer_id", "invoice_ts", "order_value")


@query("repeat_rate", """
SELECT count(*) AS n_customers, avg(CASE WHEN frequency > 1 THEN 1 ELSE 0 END) * 100 AS repeat_pct, median(frequency) AS median_orders,
       avg(frequency) AS mean_orders, max(frequency) AS max_orders, avg(CASE WHEN frequency = 1 THEN 1 ELSE 0 END) * 100 AS one_order_pct,
       avg(CASE WHEN frequency <= 2 THEN 1 ELSE 0 END) * 100 AS upto_two_pct FROM rfm_base""",
       doubles="repeat_pct median_orders mean_orders one_order_pct upto_two_pct")
def _(spark, sf):
    return distribution.repeat_rate(b.retail(spark, sf), "customer_id", "invoice")


# ---- windows, sorts, top-k, set operations, scalars

@query("top_schools_per_decade", """
SELECT decade, school_id, name, num_players, place FROM (
  SELECT *, dense_rank() OVER (PARTITION BY decade ORDER BY num_players DESC) AS place
  FROM (SELECT CAST(year // 10 * 10 AS INTEGER) AS decade, school_id, count(DISTINCT player_id) AS num_players FROM schools GROUP BY 1, 2))
LEFT JOIN school_details USING (school_id) WHERE place <= 3""")
def _(spark, sf):
    return seasons.top_schools_per_decade(b.schools(spark, sf), b.school_details(spark, sf))


@query("top_quintile_teams", """
SELECT team_id, round(avg_spend / 1000000, 1) AS avg_spend_millions
FROM (SELECT team_id, avg(total_spend) AS avg_spend, ntile(5) OVER (ORDER BY avg(total_spend) DESC, team_id) AS tile FROM team_year GROUP BY 1)
WHERE tile = 1""", doubles="avg_spend_millions")
def _(spark, sf):
    return seasons.top_quintile_teams(b.salaries(spark, sf))


@query("cumulative_spend", """
SELECT team_id, year, round(sum(total_spend) OVER (PARTITION BY team_id ORDER BY year) / 1000000, 1) AS cumulative_sum_millions FROM team_year""",
       doubles="cumulative_sum_millions")
def _(spark, sf):
    return seasons.cumulative_spend(b.salaries(spark, sf))


@query("first_year_over_threshold", """
SELECT team_id, year, round(cumulative / 1000000, 2) AS cumulative_sum
FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY cumulative) AS rn
      FROM (SELECT team_id, year, sum(total_spend) OVER (PARTITION BY team_id ORDER BY year) AS cumulative FROM team_year)
      WHERE cumulative > 150000000) WHERE rn = 1""", doubles="cumulative_sum")
def _(spark, sf):
    return seasons.first_year_over_threshold(b.salaries(spark, sf), threshold=150e6, unit=1e6)


@query("decade_over_decade_diff", """
SELECT decade, h - lag(h) OVER (ORDER BY decade) AS height_diff, w - lag(w) OVER (ORDER BY decade) AS weight_diff
FROM (SELECT CAST(year(debut) // 10 * 10 AS INTEGER) AS decade, avg(height) AS h, avg(weight) AS w FROM players WHERE debut IS NOT NULL GROUP BY 1)""",
       doubles="height_diff weight_diff")
def _(spark, sf):
    return seasons.decade_over_decade_diff(b.players(spark, sf))


def _years(a: str, z: str) -> str:
    return f"CAST(year({z}) - year({a}) - CASE WHEN strftime({z}, '%m%d') < strftime({a}, '%m%d') THEN 1 ELSE 0 END AS BIGINT)"


_AGES = (f"SELECT player_id, name, {_years('birthdate', 'debut')} AS starting_age, "
         f"{_years('birthdate', 'final_game')} AS ending_age, {_years('debut', 'final_game')} AS career_length FROM born")


@query("career_ages", _AGES)
def _(spark, sf):
    return seasons.career_ages(b.players(spark, sf))


@query("career_sort", _AGES + " ORDER BY career_length DESC NULLS LAST, player_id")
def _(spark, sf):
    return seasons.career_sort(b.players(spark, sf))


@query("union_all", """
SELECT customer_id, invoice, order_value, NULL AS batch FROM clean_tx WHERE year(invoice_ts) < 2000
UNION ALL SELECT customer_id, invoice, order_value, 'late' FROM clean_tx WHERE year(invoice_ts) >= 2000""", doubles="order_value")
def _(spark, sf):
    tx = b.cleaned(spark, sf).select("customer_id", "invoice", "order_value", "invoice_ts")
    early = tx.where(F.year("invoice_ts") < 2000).drop("invoice_ts")
    late = tx.where(F.year("invoice_ts") >= 2000).drop("invoice_ts").withColumn("batch", F.lit("late"))
    return tables.scan_union_parts([early, late])
