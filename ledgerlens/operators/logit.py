"""Unpenalised logistic regression with inference, on distributed normal equations.

Every iteration is one pass: tasks add up X'WX, the score and the deviance of their rows, a few numbers for each pair
of terms, which merge by addition; rows are never gathered. Numbers are standardised inside the fit and
the results given on their own scale. Terms are the intercept, the numeric features and one 0/1 term for each
level of each category; the terms of a model are named on the driver, as its coefficients are, and their
number is checked. A pivoted Cholesky factor of X'X reveals its rank: terms that the others determine
(one level of a full set, a charge that is a rate times its minutes) are named as aliased and left out of the
fit instead of failing it.

Missing numbers become the training median, a missing or new category has no level. Rows without label are not
learnt from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TERMS = 2000
RANK_TOLERANCE = 1e-9
_TERM = "term string, source string, level string, coef double, std_err double"


@dataclass(frozen=True)
class Term:
    """A column of the design: a number, or whether ``source`` has ``level``; the intercept has no source."""

    name: str
    source: str | None = None
    level: str | None = None


@dataclass
class LogitModel:
    """Kept terms with coefficients and covariance, and the terms that these determine."""

    terms: list[Term]
    coefs: np.ndarray
    covariance: np.ndarray
    aliased: list[str]
    medians: dict[str, float]
    deviance: float
    null_deviance: float
    rows: int

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.terms]

    def margin(self) -> Column:
        """Log-odds as an expression: no row leaves the JVM."""
        total = F.lit(0.0)
        levels: dict[str, dict[str, float]] = {}
        for term, coef in zip(self.terms, self.coefs):
            if term.source is None:
                total = total + float(coef)
            elif term.level is None:
                total = total + F.coalesce(_number(term.source), F.lit(self.medians[term.source])) * float(coef)
            else:
                levels.setdefault(term.source, {})[term.level] = float(coef)
        for source, coefs in levels.items():
            table = F.map_from_arrays(F.lit(list(coefs)), F.lit(list(coefs.values())))
            total = total + F.coalesce(F.try_element_at(table, F.col(source).cast("string")), F.lit(0.0))
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", 1 / (1 + F.exp(-self.margin())))

    def save(self, spark: SparkSession, path: str) -> None:
        row = ([(t.name, t.source, t.level) for t in self.terms], self.coefs.tolist(), self.covariance.ravel().tolist(), self.aliased, self.medians,
               self.deviance, self.null_deviance, self.rows)
        spark.createDataFrame([row], "terms array<struct<name string, source string, level string>>, coefs array<double>, covariance array<double>, "
                              "aliased array<string>, medians map<string,double>, deviance double, null_deviance double, rows long"
                              ).coalesce(1).write.mode("overwrite").parquet(f"{path}/logit")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LogitModel:
        r = spark.read.parquet(f"{path}/logit").first()
        k = len(r["coefs"])
        return LogitModel([Term(*t) for t in r["terms"]], np.array(r["coefs"]), np.array(r["covariance"]).reshape(k, k), r["aliased"], r["medians"],
                          r["deviance"], r["null_deviance"], r["rows"])


def _number(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def rank_revealing(matrix: np.ndarray, first: int = 0, tolerance: float = RANK_TOLERANCE) -> tuple[list[int], list[int]]:
    """(kept, dependent) rows of a positive semidefinite matrix, by Cholesky with the largest pivot next; ``first`` is taken first."""
    scale = np.sqrt(np.maximum(np.diag(matrix), 0))
    scale[scale == 0] = 1.0
    rest = matrix / scale / scale[:, None]
    left, kept = list(range(len(matrix))), []
    pivot = first
    while left:
        value = rest[pivot, pivot]
        if value <= tolerance:
            break
        kept.append(pivot)
        left.remove(pivot)
        column = rest[:, pivot] / math.sqrt(value)
        rest = rest - np.outer(column, column)
        # ties go to the earlier term
        pivot = max(left, key=lambda i: (round(float(rest[i, i]), 9), -i)) if left else first
    return sorted(kept), left


def design_terms(df: DataFrame, features: Sequence[str], categories: Sequence[str]) -> list[Term]:
    """The intercept, the numbers, and all levels of the categories in order."""
    terms = [Term("const"), *[Term(f, f) for f in features]]
    for c in categories:
        levels = df.select(F.col(c).cast("string").alias("level")).where("level IS NOT NULL").distinct().orderBy("level").limit(MAX_TERMS + 1).collect()
        terms += [Term(f"{c}_{r['level']}", c, r["level"]) for r in levels]
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return terms


def _normal_equations(rows: DataFrame, columns: Sequence[str], terms: Sequence[Term], centre: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """X'WX, score, deviance and rows at ``beta``, from one pass. ``rows`` has the ``columns`` and ``_label``."""
    k = len(terms)
    place = {c: i for i, c in enumerate(columns)}
    by_source: dict[str, dict[str, int]] = {}
    for j, t in enumerate(terms):
        if t.level is not None:
            by_source.setdefault(t.source, {})[t.level] = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal, score, deviance, n = np.zeros((k, k)), np.zeros(k), 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.zeros((batch.num_rows, k))
            for j, t in enumerate(terms):
                if t.source is None:
                    x[:, j] = 1.0
                elif t.level is None:
                    x[:, j] = (batch.column(place[t.source]).to_numpy(zero_copy_only=False) - centre[j]) / scale[j]
            for source, levels in by_source.items():
                coded = batch.column(place[source]).dictionary_encode()
                target = np.array([levels.get(v, -1) if v is not None else -1 for v in coded.dictionary.to_pylist()] + [-1])
                at = target[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]
                known = np.flatnonzero(at >= 0)
                x[known, at[known]] = 1.0
            y = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            eta = x @ beta
            mean = 1 / (1 + np.exp(-eta))
            normal += x.T @ (x * (mean * (1 - mean))[:, None])
            score += x.T @ (y - mean)
            deviance += 2 * float((np.logaddexp(0, eta) - y * eta).sum())
            n += len(y)
        if n:
            i, j = np.indices((k, k)).reshape(2, -1).astype(np.int32)
            # the score is column k, deviance and rows stand in row k
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([i, np.arange(k, dtype=np.int32), np.array([k, k], np.int32)])),
                pa.array(np.concatenate([j, np.full(k, k, np.int32), np.array([0, 1], np.int32)])),
                pa.array(np.concatenate([normal.ravel(), score, [deviance, float(n)]]))], ["i", "j", "value"])

    out = np.zeros((k + 1, k + 1 if k else 2))
    for r in rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # a row a pair of terms
        out[r["i"], r["j"]] = r["value"]
    return out[:k, :k], out[:k, k], float(out[k, 0]), float(out[k, 1])


def fit(train: DataFrame, features: Sequence[str], label: str = "label", categories: Sequence[str] = (), only: Sequence[str] | None = None, max_iter: int = 50) -> LogitModel:
    """Maximum likelihood by Newton steps; ``only`` restricts the design to the named terms."""
    train = train.where(F.col(label).isNotNull())
    terms = [t for t in design_terms(train, features, categories) if only is None or t.name == "const" or t.name in set(only)]
    numbers = [t.source for t in terms if t.source and t.level is None]
    sources = [*numbers, *dict.fromkeys(t.source for t in terms if t.level is not None)]
    shape = train.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("mean"), *[
        f(_number(c)).alias(f"{name}_{i}") for i, c in enumerate(numbers) for name, f in (
            ("median", lambda v: F.percentile_approx(v, 0.5, 10_000)), ("avg", F.avg), ("sd", F.stddev_pop))]).first()
    medians = {c: float(shape[f"median_{i}"] or 0.0) for i, c in enumerate(numbers)}
    rows = train.select(*[F.coalesce(_number(c), F.lit(medians[c])).alias(c) for c in numbers], *[F.col(c).cast("string").alias(c) for c in sources[len(numbers):]],
                        F.col(label).cast("double").alias("_label")).persist()
    centre, scale = np.zeros(len(terms)), np.ones(len(terms))
    for j, t in enumerate(terms):
        if t.source and t.level is None:
            i = numbers.index(t.source)
            centre[j], scale[j] = float(shape[f"avg_{i}"] or 0.0), float(shape[f"sd_{i}"] or 0.0) or 1.0
    try:
        normal, score, deviance, n = _normal_equations(rows, sources, terms, centre, scale, np.zeros(len(terms)))
        kept, dependent = rank_revealing(normal)
        aliased = [terms[j].name for j in dependent]
        terms, centre, scale = [terms[j] for j in kept], centre[kept], scale[kept]
        normal, score, beta = normal[np.ix_(kept, kept)], score[kept], np.zeros(len(kept))
        for _ in range(max_iter):
            step = np.linalg.lstsq(normal, score, rcond=None)[0]
            for _ in range(20):  # shorter, while the deviance rises
                tried = _normal_equations(rows, sources, terms, centre, scale, beta + step)
                if tried[2] <= deviance * (1 + 1e-12) + 1e-9:
                    break
                step = step / 2
            beta, gain = beta + step, deviance - tried[2]
            normal, score, deviance, _ = tried
            if gain <= 1e-12 * (abs(deviance) + 1) and np.abs(score).max(initial=0.0) <= 1e-8 * n:
                break
    finally:
        rows.unpersist()
    # back to the scale of the inputs: the intercept takes up the centres
    back = np.diag(1 / scale)
    back[0, :] -= centre / scale
    covariance = back @ np.linalg.pinv(normal) @ back.T
    mean = float(shape["mean"] or 0.0)
    null = -2 * n * (mean * math.log(mean) + (1 - mean) * math.log(1 - mean)) if 0 < mean < 1 else 0.0
    return LogitModel(terms, back @ beta, covariance, aliased, medians, deviance, null, int(n))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
