"""Scoring of newly arrived transactions with stored models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import btyd, clean, features, rfm, value
from ledgerlens.plans.training import StoredModels, learned_scores
from ledgerlens.session import materialize, stages
from ledgerlens.sources import artifacts, schemas, tables


def score_new_batch(raw: DataFrame, models: StoredModels) -> DataFrame:
    """Customer-table rows of the customers that one batch of raw transactions names.

    Each of them is scored on all lines the store has of them plus the batch, at the latest instant of
    either, with the quintile cuts of training; so a customer's orders and spend never depend on how
    files were grouped into batches. Returning customers keep their cluster; new ones belong to none.
    """
    tables.validate_schema(raw, schemas.TRANSACTION_COLUMNS)
    spark = raw.sparkSession
    arrived = materialize(clean.clean_transactions(raw))
    return _score(arrived, spark.read.parquet(models.transactions).drop("batch_id").unionByName(arrived), models)


def _score(arrived: DataFrame, known: DataFrame, models: StoredModels) -> DataFrame:
    """Rows of the customers in ``arrived``, from all their lines in ``known``."""
    spark = arrived.sparkSession
    snapshot = clean.snapshot_of(known)
    touched = arrived.select("customer_id").distinct()
    tx = materialize(known.join(touched, "customer_id", "left_semi"))
    base = materialize(rfm.rfm_table(tx, snapshot))
    scored = rfm.segment_quintile(rfm.score_by_cuts(base, spark.read.parquet(models.cuts)))
    stored = artifacts.read_customer_table(spark, models.customer_table).select("customer_id", "km_cluster", "km_label")
    customers = scored.join(stored, "customer_id", "left").withColumns({
        "km_cluster": F.coalesce("km_cluster", F.lit(-1)), "km_label": F.coalesce("km_label", F.lit("New Data"))})
    scores = learned_scores(models.spend, models.purchase, features.left_join_features_fill0(tx, snapshot))
    probabilistic = btyd.probabilistic_scores(btyd.btyd_summary(tx, snapshot), models.bgnbd, models.gamma)
    wanted = [f.name for f in schemas.CUSTOMER_TABLE.fields]
    return value.join_scores_back(customers, probabilistic, scores).select(*wanted)


def score_and_append(raw: DataFrame, models: StoredModels, run: str, delivery: int) -> int:
    """Store a batch's lines, score its customers and add them to the customer table; returns the batch number.

    A delivery is known by (run, delivery). Repeating it rewrites its own folders; another run, as after the
    loss of a stream's checkpoint, gets numbers of its own and overwrites nothing.
    """
    tables.validate_schema(raw, schemas.TRANSACTION_COLUMNS)
    spark = raw.sparkSession
    number = artifacts.batch_number(spark, models.folder, run, delivery)
    artifacts.write_batch(clean.clean_transactions(raw), models.transactions, number)
    known = spark.read.parquet(models.transactions)
    arrived = known.where(F.col("batch_id") == number).drop("batch_id")
    with stages(spark):
        # lines of later deliveries do not count when an earlier one is repeated
        rows = _score(arrived, known.where(F.col("batch_id") <= number).drop("batch_id"), models)
        # written apart first: the rows are read from the table they go to
        artifacts.write_batch(materialize(rows), models.customer_table, number)
    return number
