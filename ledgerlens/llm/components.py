"""Connected components of an edge table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that ``edges`` (a, b) names.

    Alternating large-star and small-star steps: every step hangs neighbours on the smallest node in
    sight, so a chain shortens geometrically. Each step is written to the shared folder, which cuts
    the lineage, and ends when a step changes nothing. Null ends and self-links are left out.
    """
    def larger_first(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def large_star(pairs: DataFrame) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        return larger_first(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))

    def small_star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("least"))
        linked = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return larger_first(linked.union(least.select("a", F.col("least").alias("b"))))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(larger_first(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")))
    seen = state(now)
    while True:
        now = materialize(small_star(large_star(now)))
        if (got := state(now)) == seen:
            break
        seen = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
