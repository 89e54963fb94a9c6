"""Reports over predicted lifetime value: tiers, comparisons, top customers, opportunity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.order import exact_quantiles
from ledgerlens.functions.scalars import key_hash
from ledgerlens.functions.stats import share_pct
from ledgerlens.operators.cohort import PROFIT_MARGIN
from ledgerlens.operators.wholesale import semi_join_keyset

# Fixed values: (segment, share converted, spend uplift, campaign).
SCENARIOS = (
    ("At Risk", 0.15, 0.20, "Win-back campaign: 15% convert, 20% spend increase"),
    ("Cannot Lose Them", 0.25, 0.30, "High-touch re-engagement: 25% convert, 30% increase"),
    ("Potential Loyalists", 0.20, 0.15, "2nd-purchase incentive: 20% convert, 15% increase"),
    ("Hibernating", 0.05, 0.10, "Last-chance email: 5% convert, 10% increase"),
)


def clv_describe(valued: DataFrame, columns: Sequence[str] = ("clv_90d", "clv_12m")) -> DataFrame:
    """Median, mean and total value per horizon."""
    long = valued.select(*columns).unpivot([], list(columns), "horizon", "value")
    medians = exact_quantiles(long, "value", [0.5], by=["horizon"], alias="q").select(
        "horizon", F.col("q")[0].alias("median_clv"))
    return long.groupBy("horizon").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean_clv"), F.sum("value").alias("total_clv")
    ).join(medians, "horizon")


def buyer_counts(summary: DataFrame) -> DataFrame:
    """One-time and repeat buyers with their shares."""
    once = F.col("x") == 0
    return summary.agg(
        F.count_if(once).alias("one_time"), F.count_if(~once).alias("repeat"),
        share_pct(F.count_if(once), F.count("*")).alias("one_time_pct"),
        share_pct(F.count_if(~once), F.count("*")).alias("repeat_pct"))


def clv_by_segment(customers: DataFrame, value: str = "clv_12m") -> DataFrame:
    """Customers with a value: count, mean, total and mean P(alive) per segment."""
    return customers.where(F.col(value).isNotNull()).groupBy("segment").agg(
        F.count("*").alias("n"), F.avg(value).alias("avg_clv"), F.sum(value).alias("total_clv"),
        F.avg("prob_alive").alias("avg_prob_alive"),
    ).orderBy(F.desc("avg_clv"))


def segment_clv_compare(customers: DataFrame) -> DataFrame:
    """Probabilistic and learned value side by side; segments without a value last."""
    grouped = customers.groupBy("segment").agg(
        F.count("*").alias("n_customers"), F.avg("prob_alive").alias("avg_prob_alive"),
        F.avg("clv_12m").alias("avg_clv_12m"), F.avg("clv_90d").alias("avg_clv_90d"),
        F.avg("pred_clv_90d").alias("avg_pred_clv_90d"), F.sum("total_spend").alias("total_revenue"))
    whole = grouped.select(F.sum("total_revenue")).scalar()
    return grouped.withColumn("revenue_pct", share_pct(F.col("total_revenue"), whole)).orderBy(F.desc_nulls_last("avg_clv_12m"))


def clv_tier(customers: DataFrame, value: str = "clv_12m") -> DataFrame:
    """High at or above the 66th percentile, Mid at or above the 33rd, else Low (rows with a value only)."""
    valued = customers.where(F.col(value).isNotNull())
    cuts = exact_quantiles(valued, value, [0.33, 0.66], alias="q").select("q").scalar()
    tier = F.when(F.col(value) >= F.col("_q")[1], "High CLV").when(F.col(value) >= F.col("_q")[0], "Mid CLV").otherwise("Low CLV")
    return valued.withColumn("_q", cuts).withColumn("clv_tier", tier).drop("_q")


def clv_tier_kpis(tiered: DataFrame, value: str = "clv_12m", probability: str = "prob_alive") -> DataFrame:
    """Head count, total and mean value, lowest value and mean probability per tier."""
    return tiered.groupBy("clv_tier").agg(
        F.count("*").alias("n"), F.sum(value).alias("total_clv"), F.avg(value).alias("avg_clv"),
        F.min(value).alias("from_value"), F.avg(probability).alias("avg_probability"))


def combined_clv(scores: DataFrame, spend: str = "pred_spend", probability: str = "pred_prob") -> DataFrame:
    """Predicted spend (never negative) times purchase probability."""
    floor = F.greatest(F.lit(0.0), F.col(spend))
    return scores.withColumn(spend, floor).withColumn("pred_clv_90d", F.col(spend) * F.col(probability))


def revenue_opportunity(spark: SparkSession, customers: DataFrame, margin: float = PROFIT_MARGIN) -> DataFrame:
    """Campaign scenarios with their gain after margin, plus the total in its own row.

    ``floor`` of customers times rate is taken on hundredths to stay exact.
    """
    scenarios = spark.createDataFrame(
        [(s, int(round(c * 100)), u, d) for s, c, u, d in SCENARIOS],
        "segment string, conv_pct int, uplift_rate double, strategy string")
    sized = customers.groupBy("segment").agg(F.count("*").alias("n_customers"), F.avg("monetary").alias("avg_spend"))
    lines = sized.join(F.broadcast(scenarios), "segment").select(  # four scenario rows
        "segment", "strategy", "n_customers",
        F.floor(F.col("n_customers") * F.col("conv_pct") / 100).alias("converted"),
        (F.col("avg_spend") * F.col("uplift_rate")).alias("uplift_per_customer"),
    ).withColumn("opportunity", F.col("converted") * F.col("uplift_per_customer") * margin)
    total = lines.agg(
        F.lit("Total").alias("segment"), F.sum("n_customers").alias("n_customers"),
        F.sum("converted").alias("converted"), F.sum("opportunity").alias("opportunity"))
    return lines.unionByName(total, allowMissingColumns=True)


def top_n_customers(
    customers: DataFrame, measure: str, n: int, columns: Sequence[str], key: str = "customer_id",
) -> DataFrame:
    """The n customers with the greatest measure, chosen columns only, ties in key order."""
    return customers.orderBy(F.desc_nulls_last(measure), key).limit(n).select(*columns)


def top_products_of_top_customers(
    scores: DataFrame, history: DataFrame, measure: str, customers: int = 100, products: int = 15,
) -> DataFrame:
    """What the best customers bought: quantity by product description."""
    best = scores.orderBy(F.desc_nulls_last(measure), "customer_id").limit(customers)
    return (
        semi_join_keyset(history, best)
        .groupBy("description").agg(F.sum("quantity").alias("quantity"))
        .orderBy(F.desc("quantity"), "description").limit(products)
    )


def bounded_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """At most n rows, chosen by the hash of a unique key (the same rows every time)."""
    return df.withColumn("_h", key_hash(key)).orderBy("_h", key).limit(n).drop("_h")


def scalar_metadata(customers: DataFrame, churn: DataFrame, snapshot: Column) -> DataFrame:
    """One row describing a finished run."""
    rate = churn.select(F.round(F.avg(F.col("is_churned").cast("double")), 4)).scalar()
    return customers.agg(
        F.count("*").alias("n_customers"), F.count_distinct("segment").alias("n_segments"),
        F.sum("total_spend").alias("total_revenue"),
    ).withColumns({"snapshot": snapshot.cast("date"), "churn_rate": rate, "profit_margin": F.lit(PROFIT_MARGIN)})


def join_scores_back(customers: DataFrame, probabilistic: DataFrame, learned: DataFrame) -> DataFrame:
    """Widen the customer table; all three sides are keyed and partitioned by customer."""
    return customers.join(probabilistic, "customer_id", "left").join(learned, "customer_id", "left")
