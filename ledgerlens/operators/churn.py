"""Subscription churn: rates, risk tiers, revenue at risk and the call list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.stats import share_pct

# The charge columns that add up to a monthly bill, and the tier order.
CHARGE_COLUMNS = ("total_day_charge", "total_eve_charge", "total_night_charge", "total_intl_charge")
TIERS = ("High", "Medium", "Low")


def rate_by_dimension(df: DataFrame, dimension: str, label: str = "label") -> DataFrame:
    return df.groupBy(dimension).agg(F.round(F.avg(label) * 100, 1).alias("churn_rate_pct"))


def rate_and_count_by_state(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy("state").agg(F.avg(label).alias("churn"), F.count("*").alias("n")).orderBy(F.desc("churn"), "state")


def predict_probability(scored: DataFrame, probability: str = "score") -> DataFrame:
    return scored.withColumn("churn_probability_pct", F.round(F.col(probability) * 100, 1))


def churn_risk_tiers(
    df: DataFrame, column: str = "churn_probability_pct", high: float = 70, medium: float = 40, closed: str = "left",
) -> DataFrame:
    """High, Medium or Low by percentage.

    ``closed='left'`` counts a value on a threshold to the tier above it,
    ``closed='right'`` to the tier below. Zero is always Low.
    """
    value = F.col(column)
    if closed == "left":
        tier = F.when(value >= high, "High").when(value >= medium, "Medium").when(value.isNotNull(), "Low")
    elif closed == "right":
        tier = F.when(value > high, "High").when(value > medium, "Medium").when(value.isNotNull(), "Low")
    else:
        raise ValueError("closed must be 'left' or 'right'")
    return df.withColumn("risk_tier", tier)


def monthly_value(df: DataFrame, day_charge_times: float | None = None) -> DataFrame:
    """Monthly revenue proxy: all charges, or a multiple of the day charge."""
    if day_charge_times is None:
        proxy: Column = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in CHARGE_COLUMNS if c in df.columns), F.lit(0.0))
    else:
        proxy = F.col("total_day_charge") * day_charge_times
    return df.withColumn("monthly_value", F.round(proxy, 2))


def tier_summary(df: DataFrame, probability: str = "churn_probability_pct") -> DataFrame:
    """Customers, revenue and mean probability per tier, highest risk first.

    Tiers without customers are listed too, with a count of zero.
    """
    spark = df.sparkSession
    order = spark.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "risk_tier string, position int")
    grouped = df.groupBy("risk_tier").agg(
        F.count("*").alias("customers"), F.sum("monthly_value").alias("total_rev"), F.avg(probability).alias("avg_prob"))
    whole = df.select(F.sum("monthly_value")).scalar()
    return order.join(grouped, "risk_tier", "left").select(
        "position", "risk_tier", F.coalesce("customers", F.lit(0)).alias("customers"),
        F.coalesce("total_rev", F.lit(0.0)).alias("total_rev"), "avg_prob",
        share_pct(F.coalesce("total_rev", F.lit(0.0)), whole).alias("revenue_share_pct"),
    ).orderBy("position")


def revenue_at_risk(df: DataFrame) -> DataFrame:
    """Monthly revenue of the High tier against the total."""
    high = F.coalesce(F.sum(F.when(F.col("risk_tier") == "High", F.col("monthly_value"))), F.lit(0.0))
    return df.agg(high.alias("high_tier_revenue"), F.sum("monthly_value").alias("total_revenue"),
                  share_pct(high, F.sum("monthly_value")).alias("high_tier_pct"))


def call_list(
    df: DataFrame, key: str, columns: Sequence[str], n: int = 50, probability: str = "churn_probability_pct",
    tiers: Sequence[str] = ("High",),
) -> DataFrame:
    """The n likeliest churners of the chosen tiers with the columns a caller needs."""
    shown = [key, probability, "risk_tier", "monthly_value", *[c for c in columns if c in df.columns]]
    return df.where(F.col("risk_tier").isin(list(tiers))).orderBy(F.desc(probability), key).limit(n).select(*shown)
