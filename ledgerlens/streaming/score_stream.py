"""Arriving transaction files scored into the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.plans.scoring import score_and_append
from ledgerlens.plans.training import StoredModels
from ledgerlens.sources import schemas


def stream_score_append(
    spark: SparkSession, source: str, models: StoredModels, checkpoint: str, files_per_batch: int = 1000, fmt: str = "parquet",
) -> StreamingQuery:
    """Score every new file once and append it to ``models.customer_table``.

    Micro-batches are deliveries of the run that the checkpoint's query id names: repeated after a failure they
    rewrite their own folders, and a new checkpoint (which reads all files again) overwrites nothing.
    """
    reader = spark.readStream.schema(schemas.TRANSACTIONS).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)

    def sink(batch: DataFrame, batch_id: int) -> None:
        run = batch._jdf.sparkSession().sparkContext().getLocalProperty("sql.streaming.queryId")
        score_and_append(batch, models, str(run), batch_id)

    return (
        reader.format(fmt).load(source).writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
