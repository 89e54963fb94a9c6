"""Stored parameters, fitted pipelines and the append-only customer table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.boosting import BoostedModel
from ledgerlens.operators.logit import LogitModel
from ledgerlens.sources.tables import scan_union_parts


def save_params(spark: SparkSession, path: str, params: Mapping[str, float]) -> None:
    """One-row Parquet table of plain model parameters."""
    one_row = spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in params.items()])
    one_row.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> dict[str, float]:
    """Read the single parameter row back as a dictionary."""
    return spark.read.parquet(path).first().asDict()


def save_model(model: PipelineModel | BoostedModel | LogitModel, path: str) -> None:
    """A fitted pipeline keeps its feature order in its assembler stage, the models of this package in tables of their own."""
    if isinstance(model, (BoostedModel, LogitModel)):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | BoostedModel | LogitModel:
    spark = SparkSession.active()
    for kind, table in ((BoostedModel, "trees"), (LogitModel, "logit")):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return kind.load(spark, path)
    return PipelineModel.load(path)


def keep_latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order`` value.

    A partial aggregate (not a window) so that a key with very many versions is
    reduced before the shuffle. ``order`` must be unique within a key; a row
    without it counts as the oldest, and is kept where it is the only one.
    """
    payload = [c for c in df.columns if c != key]
    newest = F.struct(F.col(order).isNotNull(), F.col(order))
    best = df.groupBy(key).agg(F.max_by(F.struct(*payload), newest).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def append_scored(stored: DataFrame, scored: DataFrame, key: str = "customer_id", order: str = "batch_ts") -> DataFrame:
    """Stored rows plus a newly scored batch; a returning customer is replaced."""
    return keep_latest(scan_union_parts([stored, scored]), key, order)


def write_batch(scored: DataFrame, table: str, batch_id: int) -> None:
    """Write one scored batch as its own folder of an append-only table.

    Re-delivering a batch overwrites the same folder, which makes the sink
    idempotent without a lock or a rewrite of the other batches.
    """
    scored.write.mode("overwrite").parquet(f"{table}/batch_id={int(batch_id)}")


def batch_number(spark: SparkSession, folder: str, run: str, delivery: int) -> int:
    """Number of a delivery: the one it had before, else the next free one. Training is number 0.

    The list of deliveries is a small table under ``folder``, one row a batch, for a single writer.
    """
    path, schema = f"{folder}/deliveries", "run string, delivery long, batch_id long"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    rows = spark.read.schema(schema).parquet(path) if known else spark.createDataFrame([], schema)
    had = rows.agg(F.max(F.when((F.col("run") == run) & (F.col("delivery") == delivery), F.col("batch_id"))).alias("same"),
                   F.coalesce(F.max("batch_id"), F.lit(0)).alias("last")).first()
    if had["same"] is not None:
        return had["same"]
    spark.createDataFrame([(run, delivery, had["last"] + 1)], schema).coalesce(1).write.mode("append").parquet(path)
    return had["last"] + 1


def read_customer_table(spark: SparkSession, table: str, key: str = "customer_id") -> DataFrame:
    """Current customer table: the newest batch wins per key (merge on read)."""
    return keep_latest(spark.read.parquet(table), key, "batch_id")


def compact_customer_table(spark: SparkSession, table: str, target: str, key: str = "customer_id") -> None:
    """Fold all batches into one at ``target``, keeping each row's batch number."""
    read_customer_table(spark, table, key).write.mode("overwrite").partitionBy("batch_id").parquet(target)
