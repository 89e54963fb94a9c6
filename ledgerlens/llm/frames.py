"""Helpers shared by the operators: tables, Arrow batches, whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import materialize

BATCH_BYTES = 8_000_000

__all__ = ["materialize", "read", "map_batches", "partitions_for"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, finish: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``; nothing larger than a batch is held.

    Batches are bounded by bytes, not only by rows, so long texts do not add up in a Python worker.
    ``finish`` runs at the end of each partition, to give back what a worker process would keep.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        if finish:
            finish()

    return df.mapInArrow(run, schema)


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions that keep about ``bytes_each`` of the plan's estimated size in each; grows with the input."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size // bytes_each + 1, 1_000_000))
