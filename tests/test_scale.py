"""Steps of the registered queries that must not gather the whole input."""

from pyspark.sql import functions as F

from checks.catalog import ENTRIES
from ledgerlens.operators import wholesale


def test_bands_of_kmeans_scan_need_no_window_over_all_rows(spark, small, monkeypatch):
    def gathered(*_):
        raise AssertionError("a window over all rows")

    monkeypatch.setattr(F, "ntile", gathered)
    assert [tuple(r) for r in ENTRIES["kmeans_scan"].run(spark, small).orderBy("k").collect()] == [(k, True, True) for k in range(2, 9)]


def test_lines_are_not_shuffled_to_leave_out_few_bulk_buyers(spark):
    """The join knows how small the stored keys are, where the summary of all customers is too large to broadcast."""
    lines = spark.range(30_000).select(
        (F.col("id") % 10_000).cast("string").alias("customer_id"),
        F.when(F.col("id") % 10_000 == 7, 900.0).otherwise(1.0 + F.col("id") % 3).alias("quantity")).withColumn("order_value", F.col("quantity") * 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
    try:
        kept = wholesale.detect_wholesale(lines)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() == 29_997 and kept.where("customer_id = '7'").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
