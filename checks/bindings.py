"""Logical inputs of the operators, derived from the shared test tables.

The expressions here and the common table expressions of ``prelude.py`` say the
same thing in Spark and in SQL. Irregularities (missing keys, returns, bulk
buyers, unparsable dates) are deterministic arithmetic on keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.prelude import BGNBD, GAMMA
from ledgerlens.functions.scalars import minus_days, whole_days
from ledgerlens.operators import btyd, clean, cluster, features, rfm, value, wholesale
from ledgerlens.session import shared_folder, materialize

_STORED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder next to the written stages, where every executor can write."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A stage output that later stages read, written once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = materialize(build(spark, sf))
    return _STORED[key]


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    factor = F.when(F.col("l_partkey") % 101 == 0, -1).when(F.col("o_custkey") % 40 == 0, 20).otherwise(1)
    return joined.select(
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey").cast("double")).alias("customer_id"),
        F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("o_orderkey").cast("string")).alias("invoice"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.col("p_name").alias("description"),
        (F.col("l_quantity") * factor).alias("quantity"),
        F.col("o_orderdate").cast("timestamp").alias("invoice_ts"),
        F.when(F.col("l_partkey") % 103 == 0, 0.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_transactions(transactions(spark, sf))


def retail(spark: SparkSession, sf: str) -> DataFrame:
    """Clean transactions of ordinary customers (read by most later stages)."""
    return stored(spark, sf, "retail", lambda s, d: wholesale.detect_wholesale(cleaned(s, d)))


def rfm_base(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "rfm_base", lambda s, d: rfm.rfm_table(retail(s, d)))


def rfm_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Customer table up to the segment."""
    return stored(spark, sf, "rfm_scored", lambda s, d: rfm.segment_quintile(rfm.rfm_score_quintile(rfm_base(s, d))))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    stamp = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    delivered = F.date_format(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '7' DAY"), "yyyy-MM-dd HH:mm:ss")
    return o.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered").otherwise("open").alias("order_status"),
        F.when(F.col("o_orderkey") % 97 == 0, "unknown").otherwise(stamp).alias("order_purchase_timestamp"),
        F.when(F.col("o_orderstatus") == "F", delivered).alias("order_delivered_customer_date"),
    )


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
        F.col("l_extendedprice").alias("price"))


def order_customers(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_unique_id"),
        F.col("n_name").alias("customer_state"))


def payments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("payment_value"))


def salaries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(
        F.concat(F.lit("T"), (F.col("o_orderkey") % 25).cast("string")).alias("team_id"),
        F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("year"),
    ).agg(F.sum("o_totalprice").alias("salary"))


def players(spark: SparkSession, sf: str) -> DataFrame:
    career = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").cast("date").alias("debut"), F.max("o_orderdate").cast("date").alias("final_game"))
    k = F.col("c_custkey")
    side = F.when(k % 4 == 0, "R").when(k % 4 == 1, "L").when(k % 4 == 2, "B")
    return table(spark, sf, "customer").join(career, "c_custkey", "left").select(
        k.alias("player_id"), F.col("c_name").alias("name"),
        (1960 + k % 31).cast("int").alias("birth_year"), (1 + k % 12).cast("int").alias("birth_month"),
        (1 + k % 31).cast("int").alias("birth_day"), "debut", "final_game", side.alias("bats"),
        (60 + k % 20).cast("int").alias("height"), (150 + k % 80).cast("int").alias("weight"))


def schools(spark: SparkSession, sf: str) -> DataFrame:
    lines, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(o, lines.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("player_id"), F.col("l_suppkey").alias("school_id"), F.year("l_shipdate").alias("year"))


def school_details(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").where(F.col("s_suppkey") % 10 != 0).select(
        F.col("s_suppkey").alias("school_id"), F.col("s_name").alias("name"))


def subscribers(spark: SparkSession, sf: str) -> DataFrame:
    """One subscriber per customer; order and line totals stand for calls, minutes and charges."""
    c, n, o = (table(spark, sf, t) for t in ("customer", "nation", "orders"))
    last_day = o.select(F.max("o_orderdate").cast("timestamp")).scalar()
    calls = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("int").alias("number_customer_service_calls"),
        F.min("o_orderdate").cast("timestamp").alias("_first"), F.max("o_orderdate").cast("timestamp").alias("_last"))
    lines = table(spark, sf, "lineitem")
    part = F.col("l_linenumber") % 4
    usage = lines.join(o, lines.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("c_custkey")).agg(*[
        F.coalesce(F.sum(F.when(part == i, F.col(source))), F.lit(0.0)).alias(f"total_{name}_{what}")
        for i, name in enumerate(["day", "eve", "night", "intl"])
        for source, what in (("l_quantity", "minutes"), ("l_extendedprice", "charge"))])
    wide = c.join(n, c.c_nationkey == n.n_nationkey).join(calls, "c_custkey").join(usage, "c_custkey")

    def flag(condition):
        return F.when(condition, "yes").otherwise("no")

    return wide.select(
        F.col("c_custkey").alias("subscriber_key"), F.col("n_name").alias("state"),
        F.col("c_nationkey").cast("string").alias("area_code"), F.col("c_name").alias("phone_number"),
        whole_days("_last", "_first").cast("int").alias("account_length"),
        flag(F.col("c_mktsegment") == "BUILDING").alias("international_plan"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Yes").otherwise("no").alias("voice_mail_plan"),
        *[f"total_{name}_{what}" for name in ("day", "eve", "night", "intl") for what in ("minutes", "charge")],
        "number_customer_service_calls",
        flag(F.col("_last") <= last_day - F.expr("INTERVAL '180' DAY")).alias("churn"),
    )


def subscriber_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A churn label with a probability that leans towards it, for the metric operators."""
    noise = F.pmod(F.col("subscriber_key") * 2654435761, F.lit(1000)) / 1000.0
    label = (F.col("churn") == "yes").cast("int")
    return subscribers(spark, sf).select(
        "subscriber_key", "state", label.alias("label"), (0.6 * noise + 0.4 * label).alias("score"),
        "total_day_charge", "total_eve_charge", "total_night_charge", "total_intl_charge",
        "international_plan", "number_customer_service_calls", "total_day_minutes", "voice_mail_plan")


def retail_btyd(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "btyd", lambda s, d: btyd.btyd_summary(retail(s, d)))


def valued(spark: SparkSession, sf: str) -> DataFrame:
    """Customer table with probabilistic value at fixed parameters and arithmetic stand-ins for learned scores."""
    def build(s, d):
        history, _ = clean.temporal_split(retail(s, d))
        t0 = minus_days(clean.snapshot_of(retail(s, d)), 90)
        learned = features.features_base(history, t0).select(
            "customer_id", (0.9 * F.col("sales_value_sum") / (1 + F.col("frequency"))).alias("pred_spend"),
            (1 / (1 + F.col("recency") / 90)).alias("pred_prob"))
        probabilistic = btyd.probabilistic_scores(retail_btyd(s, d), BGNBD, GAMMA)
        return value.join_scores_back(rfm_scored(s, d), probabilistic, value.combined_clv(learned))

    return stored(spark, sf, "valued", build)


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised recency, frequency and monetary with a rule-based cluster label."""
    def build(s, d):
        base = rfm_base(s, d)
        cuts = base.select(F.struct(F.percentile("recency", F.lit(0.5)).alias("r"), F.percentile("frequency", F.lit(0.5)).alias("f"))).scalar()
        label = (F.col("recency") > F.col("_c.r")).cast("int") * 2 + (F.col("frequency") > F.col("_c.f")).cast("int")
        labelled = base.withColumn("_c", cuts).withColumn("cluster", label).drop("_c")
        return cluster.standardize(labelled, ["recency", "frequency", "monetary"]).withColumn(
            "customer_key", F.col("customer_id").cast("bigint"))

    return stored(spark, sf, "scaled", build)
