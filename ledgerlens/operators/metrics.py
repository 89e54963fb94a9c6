"""Model quality from predictions: errors, confusion counts, ROC, thresholds, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.order import exact_quantiles, global_row_number, running_totals
from ledgerlens.functions.scalars import key_hash


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """R2, MAE and RMSE from one aggregation of moments."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    return df.agg(
        F.count("*").alias("n"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))


def capped_residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted", prob: float = 0.95) -> DataFrame:
    """Rows whose absolute error does not exceed its own 95th percentile."""
    with_error = df.withColumn("residual", F.col(actual) - F.col(predicted))
    cap = exact_quantiles(with_error, F.abs("residual"), [prob], alias="q").select(F.col("q")[0]).scalar()
    return with_error.where(F.abs("residual") <= cap)


def _confusion(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    y = F.col(label)
    return df.agg(
        F.count_if((y == 1) & (predicted == 1)).alias("tp"), F.count_if((y == 0) & (predicted == 1)).alias("fp"),
        F.count_if((y == 1) & (predicted == 0)).alias("fn"), F.count_if((y == 0) & (predicted == 0)).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str = "label", score: str = "score", threshold: float | Column = 0.5) -> DataFrame:
    """Confusion counts, accuracy and precision, recall and F1 of both classes (0 where undefined)."""
    predicted = (F.col(score) >= threshold).cast("int")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _confusion(df, label, predicted).select(
        "tp", "fp", "fn", "tn", _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tn, tn + fn).alias("precision_0"), _ratio(tn, tn + fp).alias("recall_0"),
        _ratio(2 * tn, 2 * tn + fp + fn).alias("f1_0"))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; ties collapse before any ordering."""
    y = F.col(label)
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties counted half (0.5 for a constant score, NULL for one class)."""
    curve = running_totals(_by_score(df, label, score), ["score"], {"neg_upto": F.col("neg")})
    # a positive beats every negative with a lower score and half of those with the same score
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return curve.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """True and false positive rate at every distinct score, highest first."""
    per_score = running_totals(
        _by_score(df, label, score), [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})
    whole = per_score.select(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return per_score.withColumn("_w", whole).select(
        F.col("score").alias("threshold"), "tp", "fp",
        F.try_divide(F.col("tp"), F.col("_w.p")).alias("tpr"), F.try_divide(F.col("fp"), F.col("_w.n")).alias("fpr"),
        F.col("_w.p").alias("n_pos"))


def youden_threshold(df: DataFrame, label: str = "label", score: str = "score", default: float = 0.5) -> DataFrame:
    """Score with the greatest TPR - FPR (the highest one on ties), and F1 there and at the default."""
    curve = roc_curve(df, label, score).withColumn("j", F.col("tpr") - F.col("fpr"))

    def f1(at: Column) -> Column:
        return _ratio(2 * at["tp"], at["tp"] + at["fp"] + at["n_pos"])

    best = F.max_by(F.struct("threshold", "tp", "fp", "n_pos", "j"), F.struct("j", "threshold"))
    # at the default the confusion counts are those of the lowest score still accepted
    usual = F.min_by(F.struct("tp", "fp", "n_pos"), F.when(F.col("threshold") >= default, F.col("threshold")))
    return curve.agg(best.alias("b"), usual.alias("u")).select(
        F.round("b.threshold", 3).alias("threshold"), F.col("b.j").alias("youden_j"),
        f1(F.col("b")).alias("f1_optimal"), F.coalesce(f1(F.col("u")), F.lit(0.0)).alias("f1_default"))


def hash_split(df: DataFrame, key: Column | str, train_tenths: int = 8) -> DataFrame:
    """Add ``is_train`` from the key's hash: repeatable, and independent of partitioning."""
    return df.withColumn("is_train", (key_hash(key) % 10) < train_tenths)


def stratified_split(df: DataFrame, key: str, label: str = "label", train_share: float = 0.8) -> DataFrame:
    """Exactly ``floor(share * n)`` rows of each class into training, chosen by hash order.

    Rows without label are a class of their own.
    """
    hashed = df.withColumn("_h", key_hash(key))
    ranked = global_row_number(hashed, ["_h", key], "_no", by=[label], size="_n")
    return ranked.withColumn(
        "is_train", F.col("_no") <= F.floor(F.lit(train_share) * F.col("_n"))).drop("_h", "_no", "_n")


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight of a positive row: negatives per positive; negatives weigh one."""
    ratio = df.select(F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1))).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(1.0))


def fold_column(df: DataFrame, key: Column | str, folds: int = 5) -> DataFrame:
    """Plain folds 0..k-1 from the key's hash."""
    return df.withColumn("fold", ((key_hash(key) / 10).cast("bigint") % folds).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str = "label", folds: int = 5) -> DataFrame:
    """Folds whose class shares agree: round robin over the hash order within each class."""
    ranked = global_row_number(df.withColumn("_h", key_hash(key)), ["_h", key], "_no", by=[label])
    return ranked.withColumn("fold", (F.col("_no") % folds).cast("int")).drop("_h", "_no")
