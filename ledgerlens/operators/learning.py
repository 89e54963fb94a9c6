"""Supervised models: logistic inference, boosted trees, Tweedie spend, explanations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.order import exact_quantiles
from ledgerlens.functions.scalars import as_column
from ledgerlens.operators import boosting, logit
from ledgerlens.operators.boosting import DEPTH, LEARNING_RATE, TREES, TWEEDIE_POWER, BoostedModel, Settings, Spec
from ledgerlens.operators.logit import LogitModel
from ledgerlens.operators.metrics import classification_metrics, regression_metrics

# Fixed value: the two-sided 95% normal quantile.
NORMAL_975 = 1.959963984540054


def one_hot_stages(columns: Sequence[str], drop_last: bool = False) -> list:
    """Pipeline stages from category text to one-hot vectors (levels in alphabetical order)."""
    indexed = [f"{c}_index" for c in columns]
    return [
        StringIndexer(inputCols=list(columns), outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_vec" for c in columns], dropLast=drop_last),
    ]


def one_hot_encode(df: DataFrame, columns: Sequence[str], sparse: bool = False) -> DataFrame:
    """Replace category columns by one 0/1 column per level, none dropped.

    ``sparse`` gives one sparse vector ``<name>_vec`` a column instead, which suits
    columns with very many levels; the levels are then indexed by Spark.
    """
    if sparse:
        fitted = Pipeline(stages=one_hot_stages(columns)).fit(df)
        return fitted.transform(df).drop(*columns, *[f"{c}_index" for c in columns])
    out = df
    for c in columns:
        levels = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()]  # they become column names
        out = out.withColumns({
            f"{c}_{level}": F.coalesce((F.col(c) == level).cast("int"), F.lit(0)) for level in sorted(levels)}).drop(c)
    return out


def _inputs(features: Sequence[str], categories: Sequence[str] = ()) -> list:
    """Stages from columns to ``features``: missing numbers become the training median, categories one-hot vectors.

    ``sources.tables.missing_audit`` counts what is missing beforehand; a missing category is a level of its own.
    """
    filled = [f"_filled_{c}" for c in features]
    return [
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
        *(one_hot_stages(categories, drop_last=True) if categories else []),
        VectorAssembler(inputCols=[*filled, *[f"{c}_vec" for c in categories]], outputCol="features", handleInvalid="error"),
        SQLTransformer(statement="SELECT * EXCEPT (" + ", ".join(f"`{c}`" for c in [*filled, *[f"{c}_{k}" for c in categories for k in ("index", "vec")]]) + ") FROM __THIS__"),
    ]


def fit_logit(train: DataFrame, features: Sequence[str], label: str = "label", categories: Sequence[str] = ()) -> LogitModel:
    """Unpenalised logistic regression on numbers and all levels of categories; adds ``probability``."""
    return logit.fit(train, features, label, categories)


def logit_inference(train: DataFrame, features: Sequence[str], label: str = "label", categories: Sequence[str] = ()) -> DataFrame:
    """Coefficient table of an unpenalised logistic regression, with the pseudo R2 on every row."""
    return coefficient_table(train.sparkSession, fit_logit(train, features, label, categories))


def coefficient_table(spark: SparkSession, model: LogitModel) -> DataFrame:
    """coef, standard error, z, p, 95% interval, odds ratio and significance per term; aliased terms have no coefficient."""
    errors = np.sqrt(np.maximum(np.diag(model.covariance), 0))
    rows = [(name, float(c), float(e), float(c / e) if e > 0 else None, logit.two_sided(c / e) if e > 0 else None, False)
            for name, c, e in zip(model.names, model.coefs, errors)]
    rows += [(name, None, None, None, None, True) for name in model.aliased]
    pseudo = 1 - model.deviance / model.null_deviance if model.null_deviance else 0.0
    table = spark.createDataFrame(rows, "feature string, coef double, std_err double, z double, p_value double, aliased boolean")
    return table.select(
        "feature", "coef", "std_err", "z", "p_value", (F.col("coef") - NORMAL_975 * F.col("std_err")).alias("ci_low"),
        (F.col("coef") + NORMAL_975 * F.col("std_err")).alias("ci_high"),
        F.round(F.exp("coef"), 4).alias("odds_ratio"), F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"),
        F.lit(float(pseudo)).alias("pseudo_r2"), "aliased")


def effect_text(table: DataFrame) -> DataFrame:
    """Significant terms by odds ratio with the percentage change of the odds in words."""
    ratio = F.col("odds_ratio")
    words = F.when(ratio > 1, F.concat(F.round((ratio - 1) * 100).cast("int").cast("string"), F.lit("% MORE likely to churn"))).otherwise(
        F.concat(F.round((1 - ratio) * 100).cast("int").cast("string"), F.lit("% LESS likely to churn")))
    return table.where(F.col("significant") & (F.col("feature") != "const")).withColumn("effect", words).orderBy(F.desc("odds_ratio"))


def exact_auc(scored: DataFrame, score: str, label: str = "label") -> float:
    """Area under the ROC curve without score binning."""
    return BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0
    ).evaluate(scored.select(F.col(label).cast("double").alias(label), F.col(score).cast("double").alias(score)))


def logit_reduced(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "label", categories: Sequence[str] = ()) -> DataFrame:
    """Full model against the model on its significant terms: size, accuracy, AUC."""
    spark = train.sparkSession
    full = fit_logit(train, features, label, categories)
    kept = [r["feature"] for r in effect_text(coefficient_table(spark, full)).collect()] or [n for n in full.names if n != "const"]
    reduced = logit.fit(train, features, label, categories, only=kept)
    rows = []
    for name, model in (("full", full), ("reduced", reduced)):
        scored = model.transform(test).persist()
        accuracy = classification_metrics(scored, label, "probability").first()["accuracy"]
        used = [n for n in model.names if n != "const"]
        rows.append((name, len(used), float(accuracy), float(exact_auc(scored, "probability", label)), ", ".join(used)))
        scored.unpersist()
    return spark.createDataFrame(rows, "model string, n_features int, accuracy double, auc double, features string")


def what_if_probability(
    model: LogitModel, data: DataFrame, features: Sequence[str], changes: Mapping[str, Sequence[float]], categories: Sequence[str] = (),
) -> DataFrame:
    """Predicted probability of the median profile with one feature set to each given value; the profile has no level."""
    spark = data.sparkSession
    long = data.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "feature", "value")
    medians = exact_quantiles(long, "value", [0.5], by=["feature"], alias="q")
    profile = {r["feature"]: r["q"][0] for r in medians.collect()}  # one row per model feature
    rows = [(name, float(v), *[float(v if c == name else profile[c]) for c in features])
            for name, values in changes.items() if name in features for v in values]
    schema = "changed string, set_to double, " + ", ".join(f"`{c}` double" for c in features)
    wide = spark.createDataFrame(rows, schema).withColumns({c: F.lit(None).cast("string") for c in categories})
    return model.transform(wide).select(
        "changed", "set_to", "probability", F.round(F.col("probability") * 100, 1).alias("probability_pct"))


def boosted_classifier(
    train: DataFrame, features: Sequence[str], label: str = "label", trees: int = TREES, depth: int = DEPTH,
    learning_rate: float = LEARNING_RATE, weighted: bool = True, seed: int = 42, categories: Sequence[str] = (),
) -> BoostedModel:
    """Gradient boosted trees with row and column sampling and a class weight; rows without label are left out."""
    spec = Spec(label, "logistic", balanced=weighted, seed=seed)
    return boosting.fit_many(train, features, [spec], Settings(trees, depth, learning_rate), categories)[0]


def boosted_tweedie(
    train: DataFrame, features: Sequence[str], target: str, trees: int = TREES, depth: int = DEPTH,
    learning_rate: float = LEARNING_RATE, seed: int = 42,
) -> BoostedModel:
    """Boosted spend model for zero-inflated, right-skewed targets: Tweedie deviance, log link."""
    return boosting.fit_many(train, features, [Spec(target, "tweedie", seed=seed)], Settings(trees, depth, learning_rate))[0]


def positive_probability(scored: DataFrame, alias: str = "pred_prob") -> DataFrame:
    """The boosted model's answer under a name of its own."""
    return scored.withColumnRenamed("prediction", alias).drop("margin")


def tweedie_deviance(scored: DataFrame, actual: str, predicted: str, power: float = TWEEDIE_POWER) -> DataFrame:
    """Mean deviance of a Tweedie distribution with variance power between 1 and 2."""
    y, m = F.col(actual).cast("double"), F.greatest(F.col(predicted), F.lit(1e-12))
    unit = 2 * (F.pow(y, F.lit(2 - power)) / ((1 - power) * (2 - power)) - y * F.pow(m, F.lit(1 - power)) / (1 - power) + F.pow(m, F.lit(2 - power)) / (2 - power))
    return scored.agg(F.count("*").alias("n"), F.avg(unit).alias("deviance"))


def log_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Signed log1p copies ``log_<name>``: keeps the log-link mean within range on skewed inputs."""
    return df.withColumns({
        f"log_{c}": F.signum(F.col(c).cast("double")) * F.log1p(F.abs(F.col(c).cast("double"))) for c in features})


def tweedie_regression(train: DataFrame, features: Sequence[str], target: str, power: float = TWEEDIE_POWER) -> PipelineModel:
    """Spend model for zero-inflated, right-skewed targets: Tweedie family, log link, ridge 1e-3.

    Input must have passed ``log_features``. The target is fitted in units of its
    mean, near which the iteration starts, and predictions are scaled back.
    """
    scale = float(train.agg(F.avg(target)).first()[0] or 1.0)
    inputs = Pipeline(stages=_inputs([f"log_{c}" for c in features])).fit(train)
    glm = GeneralizedLinearRegression(
        family="tweedie", variancePower=power, linkPower=0.0, labelCol="_scaled_target", featuresCol="features",
        predictionCol="_scaled_spend", maxIter=50, regParam=1e-3)
    fitted = glm.fit(inputs.transform(train.withColumn("_scaled_target", F.col(target) / scale)))
    back = SQLTransformer(statement=f"SELECT *, _scaled_spend * {scale!r}D AS pred_spend FROM __THIS__")
    return PipelineModel(stages=[inputs, fitted, back])


def cross_validate(
    df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    measure: Callable[[DataFrame], Mapping[str, float]], folds: int = 5, fold: str = "fold",
) -> DataFrame:
    """Mean and standard deviation of each metric over held-out folds.

    ``fit(train)`` returns a scorer, ``measure(scored)`` a dictionary of metrics.
    """
    results = [measure(fit(df.where(F.col(fold) != i))(df.where(F.col(fold) == i))) for i in range(folds)]
    return _over_folds(df.sparkSession, results)


def fold_specs(label: str, objective: str, folds: int = 5, fold: str = "fold", seed: int = 42) -> list[Spec]:
    """One model a fold, which learns from the other folds; to be fitted in one scan."""
    return [Spec(label, objective, F.col(fold) != i, objective == "logistic", seed) for i in range(folds)]


def fold_scores(
    df: DataFrame, models: Sequence[BoostedModel], measure: Callable[[DataFrame], Mapping[str, float]], fold: str = "fold",
) -> DataFrame:
    """Mean and standard deviation of each metric over held-out folds, every row scored by its fold's model."""
    scored = boosting.out_of_fold(df, models, fold).persist()
    try:
        return _over_folds(df.sparkSession, [measure(scored.where(F.col(fold) == i)) for i in range(len(models))])
    finally:
        scored.unpersist()


def _over_folds(spark: SparkSession, results: Sequence[Mapping[str, float]]) -> DataFrame:
    rows = [(name, i, float(r[name])) for i, r in enumerate(results) for name in r]
    return spark.createDataFrame(rows, "metric string, fold int, value double").groupBy("metric").agg(
        F.count("*").alias("folds"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def regression_scores(scored: DataFrame, actual: str, predicted: str) -> dict[str, float]:
    row = regression_metrics(scored, actual, predicted).first()
    return {"r2": row["r2"], "mae": row["mae"]}


def classification_scores(scored: DataFrame, label: str, score: str) -> dict[str, float]:
    return {"auc": exact_auc(scored, score, label), "f1": classification_metrics(scored, label, score).first()["f1"]}


def _linear_terms(df: DataFrame, coefs: Mapping[str, float]) -> DataFrame:
    means = df.select(F.struct(*[F.avg(c).alias(c) for c in coefs])).scalar()
    return df.withColumn("_mean", means)


def _term(name: str, coef: float) -> Column:
    return F.lit(float(coef)) * (as_column(name).cast("double") - F.col(f"_mean.{name}"))


def feature_importance_global(df: DataFrame, coefs: Mapping[str, float]) -> DataFrame:
    """Mean absolute contribution of each feature to the log-odds of a linear model."""
    wide = _linear_terms(df, coefs).agg(*[F.avg(F.abs(_term(n, c))).alias(n) for n, c in coefs.items()])
    return wide.unpivot([], list(coefs), "feature", "importance").orderBy(F.desc("importance"))


def row_contributions(df: DataFrame, coefs: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """Signed contribution of every feature for every row given, greatest magnitude first.

    For a linear predictor coef * (x - mean) is the exact Shapley value of the
    log-odds. Means are taken over ``df``; filter the result for single rows.
    """
    wide = _linear_terms(df, coefs).select(*keys, *[_term(n, c).alias(n) for n, c in coefs.items()])
    return wide.unpivot(list(keys), list(coefs), "feature", "contribution").withColumn(
        "direction", F.when(F.col("contribution") > 0, "pushes toward churn").otherwise("reduces churn risk"))


def tree_importance(model: BoostedModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Share of the total gain of the features asked for."""
    return boosting.importance(model, spark).where(F.col("feature").isin(list(features)))
