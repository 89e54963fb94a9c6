"""Scans, header and schema checks, sinks and audits of raw tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.order import exact_quantiles


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Headered CSV with a declared schema (no inference pass over the files)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack several parts by column name; columns absent from a part become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def validate_schema(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Pass ``df`` through, or fail naming every missing column."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trim, lower-case and underscore the column names."""
    return df.toDF(*[re.sub(" ", "_", c.strip().lower()) for c in df.columns])


def sink_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite",
) -> None:
    """Persist a result table; CSV keeps a header row."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def _numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def profile_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max of each numeric column.

    All columns are unpivoted once, so a wide table is profiled by one grouped
    aggregation plus one grouped quantile search.
    """
    columns = list(columns or _numeric_columns(df))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"], alias="q")
    return moments.join(quartiles.drop("n"), "column", "left").select(
        "column", "count", "mean", "std", "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max",
    )


def missing_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count and percentage per column, for the columns that have any."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    return (
        counts.unpivot(["_rows"], columns, "column", "missing_count")
        .where(F.col("missing_count") > 0)
        .select("column", "missing_count",
                F.round(F.col("missing_count") / F.col("_rows") * 100, 2).alias("missing_pct"))
    )


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Row count, distinct count and whether ``key`` identifies a row."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(key).alias("n_distinct"),
        (F.coalesce(F.max("_n"), F.lit(0)) <= 1).alias("is_unique"),
    )


def dataset_summary(df: DataFrame, customer: str, ts: str, value: str) -> DataFrame:
    """Rows, distinct customers, date range and total value in one pass."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(customer).alias("n_customers"),
        F.min(ts).cast("date").alias("first_date"),
        F.max(ts).cast("date").alias("last_date"),
        F.sum(value).alias("total_value"),
    )
