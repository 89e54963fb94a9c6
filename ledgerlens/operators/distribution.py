"""Shape of a measure: moments, quantiles, boxes, histograms, frequencies, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.order import exact_quantiles, salted_join
from ledgerlens.functions.stats import sample_kurtosis, sample_skewness


def distribution_stats(df: DataFrame, value: str) -> DataFrame:
    """mean, median, std, skewness, kurtosis, quartiles, IQR, P95 and P99 of a measure."""
    moments = df.agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        sample_skewness(value).alias("skewness"), sample_kurtosis(value).alias("kurtosis"),
    )
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75, 0.95, 0.99], alias="q").select("q").scalar()
    return moments.withColumn("_q", q).select(
        "mean", F.col("_q")[1].alias("median"), "std", "skewness", "kurtosis",
        F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"),
        (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"),
        F.col("_q")[3].alias("p95"), F.col("_q")[4].alias("p99"),
    )


def skew_by_column(df: DataFrame, columns: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Skewness of each column with a direction label."""
    wide = df.agg(*[sample_skewness(F.col(c).cast("double")).alias(c) for c in columns])
    label = (
        F.when(F.col("skewness") > limit, "right-skewed")
        .when(F.col("skewness") < -limit, "left-skewed")
        .otherwise("approximately symmetric")
    )
    return wide.unpivot([], list(columns), "column", "skewness").withColumn("direction", label)


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (furthest values inside the fences) and outlier count per class."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by=[by], alias="q").select(
        by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    v = F.col(value).cast("double")
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= low) & (v <= high)
    return (
        salted_join(df.select(by, value).where(v.isNotNull()), q, [by])
        .groupBy(by, "q1", "median", "q3")
        .agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
             F.count_if(~inside).alias("outliers"))
    )


def histogram(df: DataFrame, value: str | Column, bins: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed."""
    by = list(by)
    column = F.col(value) if isinstance(value, str) else value
    values = df.select(*by, column.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    span = values.select(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"))).scalar()
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    index = F.when(width > 0, F.floor((F.col("_v") - F.col("_s.lo")) / width)).otherwise(0)
    return (
        values.withColumn("_s", span)
        .select(*by, F.least(index, F.lit(bins - 1)).cast("int").alias("bin"), F.col("_s.lo").alias("_lo"), width.alias("_w"))
        .groupBy(*by, "bin", "_lo", "_w").agg(F.count("*").alias("n"))
        .select(*by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"), "n")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value with its share in percent, ordered by value."""
    total = df.select(F.count(column)).scalar()
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        .withColumn("pct", F.col("n") / total * 100).orderBy(column)
    )


def monthly_trend(df: DataFrame, ts: str, value: str, invoice: str, customer: str) -> DataFrame:
    """Lines, revenue, distinct orders and active customers per calendar month.

    Two grouping steps instead of distinct counts: lines to (month, customer, invoice), those to a row per
    invoice and to a row per customer of the month; both small results meet on the month.
    """
    per_order = df.groupBy(F.trunc(ts, "MM").alias("month"), customer, invoice).agg(F.count("*").alias("_l"), F.sum(value).alias("_v"))
    orders = per_order.groupBy("month", invoice).agg(F.sum("_l").alias("_l"), F.sum("_v").alias("_v")).groupBy("month").agg(
        F.sum("_l").alias("n_lines"), F.sum("_v").alias("revenue"), F.count(invoice).alias("n_orders"))
    buyers = per_order.select("month", customer).distinct().groupBy(F.col("month").alias("_m")).agg(F.count(customer).alias("n_customers"))
    return orders.join(buyers, F.col("month").eqNullSafe(F.col("_m"))).drop("_m").orderBy("month")


def repeat_rate(df: DataFrame, customer: str, invoice: str) -> DataFrame:
    """Share of customers with more than one order; median, mean and max orders."""
    per_customer = df.groupBy(customer).agg(F.count_distinct(invoice).alias("n"))
    # the median runs over order counts, whose distinct values are few
    return per_customer.agg(
        F.count("*").alias("n_customers"),
        (F.avg((F.col("n") > 1).cast("double")) * 100).alias("repeat_pct"),
        F.percentile("n", F.lit(0.5)).alias("median_orders"),
        F.avg("n").alias("mean_orders"),
        F.max("n").alias("max_orders"),
        (F.avg((F.col("n") == 1).cast("double")) * 100).alias("one_order_pct"),
        (F.avg((F.col("n") <= 2).cast("double")) * 100).alias("upto_two_pct"),
    )
