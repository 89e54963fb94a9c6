"""Descriptive lifetime value: churn by purchase interval, aggregate and cohort value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import whole_days
from ledgerlens.session import materialize

# Assumptions of the descriptive value formulas.
PROFIT_MARGIN = 0.15
LIFESPAN_YEARS = 3
CHURN_EPSILON = 1e-4


def _observed_days(customers: DataFrame) -> Column:
    return customers.select(whole_days(F.max("last_purchase"), F.min("first_purchase"))).scalar()


def purchase_interval_churn(tx: DataFrame, snapshot: Column | None = None) -> DataFrame:
    """Per customer: purchase span, mean interval between orders and the churn flag.

    A customer is churned when the time since the last purchase exceeds twice the
    mean interval. With one order the interval is the whole observation period,
    so such a customer is never flagged. The log is read once: its span comes from
    the customers' rows, which are stored on the way.
    """
    per_customer = materialize(tx.groupBy("customer_id").agg(
        F.min("invoice_ts").alias("first_purchase"), F.max("invoice_ts").alias("last_purchase"),
        F.count_distinct("invoice").alias("n_orders"), F.sum("order_value").alias("total_spend"),
        F.avg("order_value").alias("avg_order_value"),
    ))
    span = per_customer.select(F.struct(F.max("last_purchase").alias("hi"), F.min("first_purchase").alias("lo"))).scalar()
    per_customer = per_customer.withColumn("_s", span)
    now = snapshot if snapshot is not None else F.col("_s.hi")
    total_days = whole_days(F.col("_s.hi"), F.col("_s.lo"))
    return (
        per_customer
        .withColumn("days_since_last", whole_days(now, "last_purchase"))
        .withColumn("observation_days", whole_days("last_purchase", "first_purchase"))
        .withColumn("avg_interpurchase", F.when(
            F.col("n_orders") > 1, F.col("observation_days") / F.nullif(F.col("n_orders") - 1, F.lit(0))
        ).otherwise(total_days.cast("double")))
        .withColumn("is_churned", F.col("days_since_last") > F.col("avg_interpurchase") * 2)
        .drop("_s")
    )


def churn_rate(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count("*").alias("n_customers"), F.avg(F.col("is_churned").cast("double")).alias("churn_rate"))


def aggregate_clv(tx: DataFrame, margin: float = PROFIT_MARGIN, years: float = LIFESPAN_YEARS) -> DataFrame:
    """Population value by the lifetime method and by the churn method."""
    customers = purchase_interval_churn(tx)
    base = customers.withColumn("_y", _observed_days(customers) / 365).agg(
        F.avg("avg_order_value").alias("avg_purchase_value"),
        F.avg(F.col("n_orders") / F.col("_y")).alias("avg_frequency_year"),
        F.avg(F.col("is_churned").cast("double")).alias("churn_rate"),
    )
    annual = F.col("avg_purchase_value") * F.col("avg_frequency_year")
    lifetime, churn = annual * years, annual / (F.col("churn_rate") + CHURN_EPSILON)
    return base.select(
        "*", lifetime.alias("clv_lifetime"), (lifetime * margin).alias("clv_lifetime_profit"),
        churn.alias("clv_churn"), (churn * margin).alias("clv_churn_profit"))


def cohort_clv(tx: DataFrame, margin: float = PROFIT_MARGIN, years: float = LIFESPAN_YEARS) -> DataFrame:
    """Size, averages, churn and lifetime value by month of first purchase."""
    customers = purchase_interval_churn(tx)
    observed = _observed_days(customers) / 365
    return (
        customers
        .groupBy(F.date_format("first_purchase", "yyyy-MM").alias("cohort"))
        .agg(
            F.count("*").alias("cohort_size"), F.avg("avg_order_value").alias("avg_order_value"),
            F.avg("n_orders").alias("avg_orders"), F.avg("total_spend").alias("avg_total_spend"),
            F.avg(F.col("is_churned").cast("double")).alias("churn_rate"),
        )
        .withColumn("clv_lifetime", F.col("avg_order_value") * (F.col("avg_orders") / observed) * years * margin)
        .orderBy("cohort")
    )
