"""Order star: one row per order with its customer, revenue and payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_preaggregate(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.sum("price").alias("revenue"), F.count("order_item_id").alias("n_items"))


def payments_preaggregate(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(F.sum("payment_value").alias("payment_value"))


def star_merge_orders(orders: DataFrame, customers: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """Left-join the order facts; items and payments are summed first so nothing fans out.

    Both pre-aggregates are already hash-partitioned by order, so the two order
    joins add a shuffle of the orders side only.
    """
    return (
        orders
        .join(order_preaggregate(items), "order_id", "left")
        .join(payments_preaggregate(payments), "order_id", "left")
        .join(customers.select("customer_id", "customer_unique_id", "customer_state"), "customer_id", "left")
    )
