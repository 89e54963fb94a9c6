"""Model features before a cut-off and targets after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import minus_days, whole_days
from ledgerlens.functions.stats import sample_skewness

# Names of the feature columns in model order.
FEATURES = (
    "frequency", "sales_value_sum", "sales_value_avg", "quantity_avg", "recency",
    "txn_last_28d", "spend_last_28d", "txn_last_14d", "spend_last_14d",
    "n_unique_products", "n_unique_desc",
)


def _per_invoice(history: DataFrame, reference: Column) -> DataFrame:
    # (customer, invoice) is the grain of the first shuffle: one very large
    # customer is spread over tasks, and distinct invoices become plain counts.
    def since(days: int) -> Column:
        return F.col("invoice_ts") >= minus_days(F.col("_ref"), days)

    return history.withColumn("_ref", reference).groupBy("customer_id", "invoice").agg(
        F.max("invoice_ts").alias("_last"), F.first("_ref").alias("_ref"),
        F.sum("order_value").alias("_v"), F.count("order_value").alias("_l"), F.sum("quantity").alias("_q"),
        *[F.max(since(d)).alias(f"_in{d}") for d in (28, 14)],
        *[F.sum(F.when(since(d), F.col("order_value"))).alias(f"_v{d}") for d in (28, 14)],
    )


def _base_columns() -> list[Column]:
    return [
        F.count("invoice").alias("frequency"), F.sum("_v").alias("sales_value_sum"),
        (F.sum("_v") / F.sum("_l")).alias("sales_value_avg"), (F.sum("_q") / F.sum("_l")).alias("quantity_avg"),
        whole_days(F.first("_ref"), F.max("_last")).alias("recency"),
    ]


def _rolling_columns() -> list[Column]:
    return [c for d in (28, 14) for c in (
        F.count_if(F.col(f"_in{d}")).alias(f"txn_last_{d}d"),
        F.coalesce(F.sum(f"_v{d}"), F.lit(0.0)).alias(f"spend_last_{d}d"))]


def features_base(history: DataFrame, reference: Column) -> DataFrame:
    """Frequency, spend, mean quantity and recency at the reference instant."""
    return _per_invoice(history, reference).groupBy("customer_id").agg(*_base_columns())


def features_rolling(history: DataFrame, reference: Column) -> DataFrame:
    """Orders and spend in the 28 and 14 days before the reference, for customers active in the last 28."""
    recent = history.where(F.col("invoice_ts") >= minus_days(reference, 28))
    return _per_invoice(recent, reference).groupBy("customer_id").agg(*_rolling_columns())


def features_diversity(history: DataFrame) -> DataFrame:
    """Distinct products and descriptions, in two grouping steps: one row per customer and item, then counts."""
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("item")) for k, c in enumerate(("stock_code", "description"))]))
    seen = history.select("customer_id", items.alias("i")).groupBy("customer_id", "i").agg(F.lit(1).alias("one"))
    named = F.col("i.item").isNotNull()
    return seen.groupBy("customer_id").agg(
        F.count_if((F.col("i.kind") == 0) & named).alias("n_unique_products"),
        F.count_if((F.col("i.kind") == 1) & named).alias("n_unique_desc"))


def left_join_features_fill0(history: DataFrame, reference: Column) -> DataFrame:
    """All features per customer, absent activity as zero.

    Base and rolling features share one conditional aggregation instead of three
    joined group-bys; only the two distinct product counts need their own grouping,
    and both sides of the join are already partitioned by customer.
    """
    activity = _per_invoice(history, reference).groupBy("customer_id").agg(*_base_columns(), *_rolling_columns())
    return activity.join(features_diversity(history), "customer_id", "left").fillna(0).select("customer_id", *FEATURES)


def targets_90d(future: DataFrame) -> DataFrame:
    """Spend after the cut-off and the purchase flag."""
    return future.groupBy("customer_id").agg(F.sum("order_value").alias("sales_90_value")).withColumn(
        "purchased_flag", F.lit(1))


def left_join_labels(features: DataFrame, targets: DataFrame) -> DataFrame:
    return features.join(targets, "customer_id", "left").withColumns({
        "sales_90_value": F.coalesce("sales_90_value", F.lit(0.0)),
        "purchased_flag": F.coalesce("purchased_flag", F.lit(0)),
    })


def target_profile(model_table: DataFrame) -> DataFrame:
    """Buyers, zero share and skewness of the spend target."""
    spend = F.col("sales_90_value")
    return model_table.agg(
        F.count("*").alias("n_customers"),
        F.sum("purchased_flag").alias("n_purchasers"),
        (F.avg("purchased_flag") * 100).alias("purchaser_pct"),
        F.count_if(spend == 0).alias("n_zero"),
        (F.avg((spend == 0).cast("double")) * 100).alias("zero_pct"),
        F.avg(spend).alias("mean_spend"), F.stddev_samp(spend).alias("std_spend"),
        sample_skewness(spend).alias("skewness"),
    )
