"""Batch training: from raw transactions to a scored customer table and stored models."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import minus_days
from ledgerlens.operators import boosting, btyd, clean, cluster, cohort, features, learning, lloyd, metrics, rfm, value, wholesale
from ledgerlens.operators.boosting import BoostedModel
from ledgerlens.session import materialize, stages
from ledgerlens.sources import artifacts, schemas, tables

HORIZON_DAYS = 90
RFM_COLUMNS = ("recency", "frequency", "monetary")


@dataclass(frozen=True)
class StoredModels:
    """What scoring needs: closed-form parameters and the two learned models."""

    bgnbd: dict[str, float]
    gamma: dict[str, float]
    spend: BoostedModel
    purchase: BoostedModel
    folder: str

    @property
    def customer_table(self) -> str:
        return f"{self.folder}/customers"

    @property
    def transactions(self) -> str:
        """All cleaned lines, one folder per batch: what returning customers are scored on."""
        return f"{self.folder}/transactions"

    @property
    def cuts(self) -> str:
        """Quintile cuts of the training customers."""
        return f"{self.folder}/quintile_cuts"

    def at(self, folder: str) -> StoredModels:
        """The same models over another folder, which needs its own tables."""
        return replace(self, folder=folder)


def add_clusters(customers: DataFrame, n_init: int = 20, max_iter: int = 500, seed: int = 42) -> DataFrame:
    """K = 4 or 5 by silhouette; a fifth cluster shares the last tier name's place."""
    scaled = cluster.assemble(cluster.standardize(customers, RFM_COLUMNS), [f"z_{c}" for c in RFM_COLUMNS]).persist()
    try:
        models = lloyd.fit_all(scaled, (4, 5), n_init, max_iter, seed)  # both K and all restarts share every pass
        k = cluster.scan_table(customers.sparkSession, scaled, models).where("best").orderBy("k").first()["k"]
        labelled = models[k].transform(scaled)
        names = cluster.TIER_NAMES if k == 4 else (*cluster.TIER_NAMES, "Lowest Value")
        named = cluster.cluster_tier_label(labelled.withColumnRenamed("cluster", "km_cluster"), names=names)
        return materialize(named.select(*customers.columns, "km_cluster", "km_label"))
    finally:
        scaled.unpersist()


def learned_scores(spend: BoostedModel, purchase: BoostedModel, table: DataFrame) -> DataFrame:
    """Predicted spend, purchase probability and their product per customer."""
    scored = learning.positive_probability(purchase.transform(table), "pred_prob")
    scored = learning.positive_probability(spend.transform(scored), "pred_spend")
    return value.combined_clv(scored).select("customer_id", "pred_spend", "pred_prob", "pred_clv_90d")


def fit_learned(model_table: DataFrame, trees: int, folds: int = 5) -> tuple[BoostedModel, BoostedModel, DataFrame]:
    """Spend and purchase models on the hashed training share, with held-out and cross-validated metrics.

    The final fits and those of all folds share one scan of the training rows. The decision threshold is
    chosen on one half of the held-out rows and its F1 measured on the other half.
    """
    split = metrics.hash_split(model_table, F.xxhash64("customer_id"))
    train = materialize(metrics.stratified_folds(metrics.fold_column(split.where("is_train"), F.xxhash64("customer_id"), folds).withColumnRenamed(
        "fold", "spend_fold").withColumn("_key", F.xxhash64("customer_id")), "_key", "purchased_flag", folds).drop("_key"))
    test = split.where("NOT is_train").persist()
    try:
        models = boosting.fit_many(train, features.FEATURES, [
            boosting.Spec("sales_90_value", "tweedie"), boosting.Spec("purchased_flag", balanced=True),
            *learning.fold_specs("sales_90_value", "tweedie", folds, "spend_fold"), *learning.fold_specs("purchased_flag", "logistic", folds)],
            boosting.Settings(trees))
        spend, purchase = models[:2]
        crossed = {r["metric"]: r for r in learning.fold_scores(
            train, models[2:2 + folds], lambda s: learning.regression_scores(s, "sales_90_value", "prediction"), "spend_fold").union(learning.fold_scores(
                train, models[2 + folds:], lambda s: learning.classification_scores(s, "purchased_flag", "prediction"))).collect()}
        scored = learned_scores(spend, purchase, test).join(test, "customer_id").withColumn(
            "tuning", F.pmod(F.xxhash64("customer_id", F.lit(7)), F.lit(2)) == 0).persist()
        threshold = metrics.youden_threshold(scored.where("tuning"), "purchased_flag", "pred_prob").first()["threshold"]
        threshold = 0.5 if threshold is None else threshold
        regression = metrics.regression_metrics(scored, "sales_90_value", "pred_spend").first()
        report = train.sparkSession.createDataFrame([(
            regression["r2"], regression["mae"], learning.exact_auc(scored, "pred_prob", "purchased_flag"), threshold,
            metrics.classification_metrics(scored.where("tuning"), "purchased_flag", "pred_prob", threshold).first()["f1"],
            metrics.classification_metrics(scored.where("NOT tuning"), "purchased_flag", "pred_prob", threshold).first()["f1"],
            crossed["r2"]["mean"], crossed["r2"]["sd"], crossed["auc"]["mean"], crossed["auc"]["sd"],
        )], "reg_r2 double, reg_mae double, clf_auc double, threshold double, f1_tuning double, f1_holdout double, "
            "cv_r2 double, cv_r2_sd double, cv_auc double, cv_auc_sd double")
        scored.unpersist()
        return spend, purchase, report
    finally:
        test.unpersist()


def train_customer_models(raw: DataFrame, folder: str, trees: int = learning.TREES, n_init: int = 20) -> StoredModels:
    """Run the whole pipeline and store its results under ``folder``."""
    with stages(raw.sparkSession):
        return _train(raw, folder, trees, n_init)


def _train(raw: DataFrame, folder: str, trees: int, n_init: int) -> StoredModels:
    spark = raw.sparkSession
    artifacts.write_batch(clean.clean_transactions(raw), f"{folder}/transactions", 0)
    lines = spark.read.parquet(f"{folder}/transactions").drop("batch_id")
    tx = materialize(wholesale.detect_wholesale(lines))  # read by every later stage
    snapshot = clean.snapshot_of(tx)
    t0 = minus_days(snapshot, HORIZON_DAYS)

    base = materialize(rfm.rfm_table(tx, snapshot))
    tables.sink_table(rfm.quintile_cuts(base), f"{folder}/quintile_cuts")
    scored = rfm.score_by_cuts(base, spark.read.parquet(f"{folder}/quintile_cuts"))
    customers = add_clusters(materialize(rfm.segment_quintile(scored)), n_init)

    summary = materialize(btyd.btyd_summary(tx, snapshot))
    bgnbd, gamma = btyd.bgnbd_fit(summary), btyd.gamma_gamma_fit(summary)

    history, future = clean.temporal_split(tx, HORIZON_DAYS, snapshot=snapshot)
    feature_table = materialize(features.left_join_features_fill0(history, t0))
    model_table = features.left_join_labels(feature_table, features.targets_90d(future))
    spend, purchase, report = fit_learned(model_table, trees)
    scores = materialize(learned_scores(spend, purchase, feature_table))

    table = value.join_scores_back(customers, btyd.probabilistic_scores(summary, bgnbd, gamma), scores)
    wanted = [f.name for f in schemas.CUSTOMER_TABLE.fields]
    artifacts.write_batch(table.select(*wanted), f"{folder}/customers", 0)
    artifacts.save_params(spark, f"{folder}/bgnbd_params", bgnbd)
    artifacts.save_params(spark, f"{folder}/gamma_params", gamma)
    artifacts.save_model(spend, f"{folder}/spend_model")
    artifacts.save_model(purchase, f"{folder}/purchase_model")
    tables.sink_table(report, f"{folder}/metrics")
    tables.sink_table(value.top_products_of_top_customers(scores, history, "pred_clv_90d"), f"{folder}/top_products")
    tables.sink_table(
        value.scalar_metadata(customers, cohort.purchase_interval_churn(tx, snapshot), snapshot), f"{folder}/metadata")
    return StoredModels(bgnbd, gamma, spend, purchase, folder)


def load_models(spark: SparkSession, folder: str) -> StoredModels:
    return StoredModels(
        artifacts.load_params(spark, f"{folder}/bgnbd_params"), artifacts.load_params(spark, f"{folder}/gamma_params"),
        artifacts.load_model(f"{folder}/spend_model"), artifacts.load_model(f"{folder}/purchase_model"), folder)
