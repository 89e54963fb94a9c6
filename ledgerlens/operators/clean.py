"""Cleaning, filtering and splitting of transactions, orders and subscribers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.order import global_row_number
from ledgerlens.functions.scalars import key_text, minus_days, yes_no


def _is_return() -> Column:
    return F.coalesce(F.col("invoice").startswith("C"), F.lit(False))


def _positive() -> Column:
    return F.coalesce((F.col("quantity") > 0) & (F.col("price") > 0), F.lit(False))


def normalize_customer_key(df: DataFrame, column: str = "customer_id") -> DataFrame:
    return df.withColumn(column, key_text(column))


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Known customers' purchases with positive quantity and price, plus ``order_value``."""
    kept = raw.where(F.col("customer_id").isNotNull() & ~_is_return() & _positive())
    return normalize_customer_key(kept).withColumn("order_value", F.col("quantity") * F.col("price"))


def cleaning_audit(raw: DataFrame) -> DataFrame:
    """Rows entering and removed by each cleaning step, from one pass over the input."""
    known = F.col("customer_id").isNotNull()
    purchase = known & ~_is_return()
    counts = raw.agg(
        F.count("*").alias("n0"),
        F.count_if(known).alias("n1"),
        F.count_if(purchase).alias("n2"),
        F.count_if(purchase & _positive()).alias("n3"),
    )
    steps = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("rule"),
                 F.col(f"n{i}").alias("rows_in"), F.col(f"n{i + 1}").alias("rows_out"))
        for i, name in enumerate(["missing customer", "return invoice", "non-positive quantity or price"])
    ])
    return counts.select(F.inline(steps)).select(
        "step", "rule", "rows_in", (F.col("rows_in") - F.col("rows_out")).alias("removed"),
        F.round(F.try_divide(F.col("rows_in") - F.col("rows_out"), F.col("rows_in")) * 100, 1).alias("removed_pct"),
    )


def parse_dates_lenient(df: DataFrame, columns: Sequence[str], fmt: str | None = None) -> DataFrame:
    """Text to timestamps; what does not parse becomes NULL."""
    pattern = [] if fmt is None else [F.lit(fmt)]
    return df.withColumns({c: F.try_to_timestamp(F.col(c), *pattern) for c in columns})


def filter_completed_orders(orders: DataFrame, status: str = "delivered") -> DataFrame:
    """Completed orders with a known customer, purchase time and positive revenue."""
    return orders.where(F.col("order_status") == status).dropna(
        subset=["revenue", "order_purchase_timestamp", "customer_unique_id"]
    ).where(F.col("revenue") > 0)


def map_binary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: yes_no(c) for c in columns if c in df.columns})


def drop_identifiers(df: DataFrame, columns: Sequence[str] = ("state", "area_code", "phone_number")) -> DataFrame:
    return df.drop(*columns)


def snapshot_of(df: DataFrame, ts: str = "invoice_ts") -> Column:
    """Latest instant of ``df`` as a scalar usable in any expression."""
    return df.select(F.max(ts)).scalar()


def temporal_split(
    df: DataFrame, horizon_days: int = 90, ts: str = "invoice_ts", snapshot: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """History up to T0 = snapshot - horizon, and what happened after T0."""
    cut = minus_days(snapshot if snapshot is not None else snapshot_of(df, ts), horizon_days)
    return df.where(F.col(ts) <= cut), df.where(F.col(ts) > cut)


def filter_in_list(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def between_year_filter(df: DataFrame, date_column: str, first: int, last: int) -> DataFrame:
    return df.where(F.year(date_column).between(first, last))


def id_generator(
    df: DataFrame, order_by: Sequence[str], start: int = 1, width: int = 4, prefix: str = "CUST-", alias: str = "customer_id",
) -> DataFrame:
    """Synthetic ``CUST-0001`` keys over a stated order; long numbers are never cut."""
    numbered = global_row_number(df, list(order_by), alias="_no")
    digits = (F.col("_no") + (start - 1)).cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return numbered.withColumn(alias, F.concat(F.lit(prefix), padded)).drop("_no")
