"""Separation of bulk buyers from ordinary customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.order import exact_quantiles
from ledgerlens.functions.stats import share_pct
from ledgerlens.session import materialize


def customer_summary(tx: DataFrame) -> DataFrame:
    """Mean line value, mean quantity, spend and lines per customer."""
    return tx.groupBy("customer_id").agg(
        F.avg("order_value").alias("avg_order_value"),
        F.avg("quantity").alias("avg_quantity"),
        F.sum("order_value").alias("total_spend"),
        F.count("*").alias("n_lines"),
    )


def flag_wholesale(tx: DataFrame, k: float = 3.0) -> DataFrame:
    """Customer summary with thresholds and a flag: either mean above Q3 + k * IQR.

    The summary is read by three passes, so it is written once.
    """
    summary = materialize(customer_summary(tx))
    means = ["avg_order_value", "avg_quantity"]
    long = summary.select(*means).unpivot([], means, "measure", "value")
    q = exact_quantiles(long, "value", [0.25, 0.75], by=["measure"], alias="q")
    upper = F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])
    limits = q.select(F.struct(*[
        F.max(F.when(F.col("measure") == m, upper)).alias(m) for m in means])).scalar()
    flagged = summary.withColumn("_limit", limits).select(
        *summary.columns, F.col("_limit.avg_order_value").alias("value_threshold"),
        F.col("_limit.avg_quantity").alias("quantity_threshold"))
    return flagged.withColumn(
        "is_wholesale",
        (F.col("avg_order_value") > F.col("value_threshold")) | (F.col("avg_quantity") > F.col("quantity_threshold")))


def anti_join_keyset(tx: DataFrame, keys: DataFrame, key: str = "customer_id") -> DataFrame:
    return tx.join(keys.select(key), key, "left_anti")


def semi_join_keyset(tx: DataFrame, keys: DataFrame, key: str = "customer_id") -> DataFrame:
    return tx.join(keys.select(key), key, "left_semi")


def detect_wholesale(tx: DataFrame, k: float = 3.0) -> DataFrame:
    """Transactions of ordinary customers only.

    The bulk buyers are written first: as a table of known size, few of them are broadcast and no line is shuffled for them.
    """
    return anti_join_keyset(tx, materialize(flag_wholesale(tx, k).where("is_wholesale").select("customer_id")))


def wholesale_summary(tx: DataFrame, k: float = 3.0) -> DataFrame:
    """Sizes, shares and revenue share of the two populations with the thresholds used."""
    flag = F.col("is_wholesale")
    return flag_wholesale(tx, k).agg(
        F.max("value_threshold").alias("value_threshold"),
        F.max("quantity_threshold").alias("quantity_threshold"),
        F.count_if(~flag).alias("n_retail"),
        F.count_if(flag).alias("n_wholesale"),
        share_pct(F.count_if(~flag), F.count("*")).alias("retail_pct"),
        share_pct(F.count_if(flag), F.count("*")).alias("wholesale_pct"),
        share_pct(F.coalesce(F.sum(F.when(flag, F.col("total_spend"))), F.lit(0.0)),
                  F.sum("total_spend")).alias("wholesale_revenue_pct"),
        F.coalesce(F.sum(F.when(~flag, F.col("n_lines"))), F.lit(0)).alias("n_retail_lines"),
    )
