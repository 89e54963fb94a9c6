"""Clustering of standardised measures, choice of K and cluster quality."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.stats import share_pct
from ledgerlens.operators import lloyd, mixture
from ledgerlens.operators.lloyd import CentreModel
from ledgerlens.operators.mixture import Mixture
from ledgerlens.operators.value import bounded_sample
from ledgerlens.session import materialize

# Cluster tier names from best to worst.
TIER_NAMES = ("High Value", "Mid-High", "Mid-Low", "Low Value")


def standardize(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Add z-scores with the population standard deviation; a constant column becomes 0."""
    moments = df.select(F.struct(*[
        f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])).scalar()
    with_moments = df.withColumn("_m", moments)
    scaled = {
        f"{prefix}{c}": F.when(F.col(c).isNotNull(), F.coalesce(
            F.try_divide(F.col(c) - F.col(f"_m.mean_{c}"), F.col(f"_m.std_{c}")), F.lit(0.0)))
        for c in columns}
    return with_moments.withColumns(scaled).drop("_m")


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error").transform(df)


def kmeans_fit(vectors: DataFrame, k: int = 4, max_iter: int = 500, n_init: int = 20, seed: int = 42) -> CentreModel:
    """Best of ``n_init`` k-means runs by within-cluster sum of squares."""
    return lloyd.fit_all(vectors, [k], n_init, max_iter, seed)[k]


def kmeans_scan(
    spark: SparkSession, vectors: DataFrame, ks: Sequence[int] = range(2, 9), max_iter: int = 300, n_init: int = 15, seed: int = 42,
) -> DataFrame:
    """Cost and silhouette for each K; ``best`` marks the greatest silhouette."""
    return scan_table(spark, vectors, lloyd.fit_all(vectors, list(ks), n_init, max_iter, seed))


def scan_table(spark: SparkSession, vectors: DataFrame, models: Mapping[int, CentreModel]) -> DataFrame:
    """k, wcss, silhouette and best of fitted models."""
    evaluator = ClusteringEvaluator(predictionCol="cluster")
    vectors = vectors.select("features").persist()
    try:
        rows = [(k, m.cost, float(evaluator.evaluate(m.transform(vectors)))) for k, m in models.items()]
    finally:
        vectors.unpersist()
    top = max(r[2] for r in rows)
    return spark.createDataFrame([(*r, r[2] == top) for r in rows], "k int, wcss double, silhouette double, best boolean")


def gmm_scan(
    spark: SparkSession, vectors: DataFrame, ks: Sequence[int] = range(2, 7), n_init: int = 5, seed: int = 42,
) -> DataFrame:
    """BIC and AIC of full-covariance mixtures; ``best`` marks the lowest BIC."""
    return criteria_table(spark, mixture.fit_all(vectors, list(ks), n_init, seed))


def criteria_table(spark: SparkSession, models: Mapping[int, Mixture]) -> DataFrame:
    """k, bic, aic and best of fitted mixtures."""
    rows = []
    for k, m in models.items():
        loss, free = -2 * m.mean_log_likelihood * m.rows, m.free_parameters
        rows.append((k, float(loss + free * math.log(m.rows)), float(loss + 2 * free)))
    low = min(r[1] for r in rows)
    return spark.createDataFrame([(*r, r[1] == low) for r in rows], "k int, bic double, aic double, best boolean")


def gmm_fit_certainty(vectors: DataFrame, k: int, n_init: int = 10, seed: int = 42) -> DataFrame:
    """Hard cluster, soft membership and the greatest membership per row."""
    return mixture.fit_all(vectors, [k], n_init, seed)[k].transform(vectors).withColumn("certainty", F.array_max("membership"))


def certainty_summary(scored: DataFrame, below: float = 0.6) -> DataFrame:
    unsure = F.count_if(F.col("certainty") < below)
    return scored.agg(F.count("*").alias("n"), F.avg("certainty").alias("avg_certainty"), unsure.alias("n_uncertain"),
                      share_pct(unsure, F.count("*")).alias("uncertain_pct"))


def cluster_profile(customers: DataFrame, cluster: str = "cluster") -> DataFrame:
    return customers.groupBy(cluster).agg(
        F.count("*").alias("n"), F.avg("recency").alias("avg_recency"), F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary").alias("avg_monetary"), F.avg("rfm_score").alias("avg_rfm_score"),
    ).orderBy(F.desc("avg_rfm_score"))


def cluster_tier_label(
    customers: DataFrame, cluster: str = "km_cluster", score: str = "rfm_score", names: Sequence[str] = TIER_NAMES, alias: str = "km_label",
) -> DataFrame:
    """Name clusters by the rank of their mean score; more clusters than names is an error."""
    ranking = (
        customers.groupBy(cluster).agg(F.avg(score).alias("s")).orderBy(F.desc("s"), cluster).limit(len(names) + 1).collect())
    if len(ranking) > len(names):
        raise ValueError(f"more clusters than the {len(names)} tier names")
    chain: Column = F.lit(None).cast("string")
    for row, name in zip(ranking, names):
        chain = F.when(F.col(cluster) == row[cluster], name).otherwise(chain)
    return customers.withColumn(alias, chain)


def silhouette(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """Mean squared-distance silhouette of all rows: n and silhouette.

    The mean squared distance of a row x to a cluster of n rows with sum S and sum of squares Q is
    |x|^2 + Q/n - 2 x.S/n, so one pass for the moments (a row per cluster) and one over the rows do. Rows
    alone in their cluster count as 0, as does everything if there is one cluster. NULL labels are one cluster.
    """
    squares = sum((F.pow(c, F.lit(2)) for c in columns), F.lit(0.0))
    moments = df.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(squares).alias("q"), *[F.sum(c).alias(f"s_{c}") for c in columns])
    everyone = moments.select(F.collect_list(F.struct(F.col(cluster).alias("k"), "n", "q", *[f"s_{c}" for c in columns]))).scalar()

    def gap(o: Column) -> Column:
        return F.greatest(F.lit(0.0), F.col("_x") + o["q"] / o["n"] - 2 * sum((F.col(c) * o[f"s_{c}"] for c in columns), F.lit(0.0)) / o["n"])

    own = F.filter("_all", lambda o: o["k"].eqNullSafe(F.col(cluster)))[0]
    rows = df.withColumns({"_all": everyone, "_x": squares}).withColumn("_own", own)
    inner = gap(F.col("_own")) * F.col("_own.n") / (F.col("_own.n") - 1)
    outer = F.array_min(F.transform(F.filter("_all", lambda o: ~o["k"].eqNullSafe(F.col(cluster))), gap))
    score = F.when((F.col("_own.n") > 1) & outer.isNotNull(), F.coalesce(F.try_divide(outer - inner, F.greatest(outer, inner)), F.lit(0.0))).otherwise(0.0)
    return rows.agg(F.count("*").alias("n"), F.avg(score).alias("silhouette"))


def silhouette_sample(df: DataFrame, columns: Sequence[str], cluster: str, key: str, max_rows: int) -> DataFrame:
    """Mean Euclidean silhouette of ``max_rows`` rows chosen by key hash.

    The sample travels to every task; tasks compare their share of it with the
    whole sample, so no pairs are ever shuffled.
    """
    spark = df.sparkSession
    sample = bounded_sample(df.select(key, cluster, *columns), F.col(key), max_rows).toPandas()
    if sample.empty:
        return spark.createDataFrame([(0, None)], "n bigint, silhouette double")
    points = sample[list(columns)].to_numpy(float)
    labels, codes = np.unique(sample[cluster].to_numpy(), return_inverse=True)
    sizes = np.bincount(codes, minlength=len(labels))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total, n = 0.0, 0
            rows = pdf["id"].to_numpy()
            for at in range(0, len(rows), 256):
                take = rows[at:at + 256]
                gap = np.sqrt(((points[take][:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
                sums = np.stack([gap[:, codes == c].sum(axis=1) for c in range(len(labels))], axis=1)
                own = codes[take]
                here = np.arange(len(take))
                others = sizes[own] - 1
                inner = sums[here, own] / np.maximum(others, 1)
                means = sums / sizes
                means[here, own] = np.inf
                outer = means.min(axis=1)
                s = np.where(others > 0, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0)
                total += float(np.where(np.isfinite(outer), s, 0.0).sum())
                n += len(take)
            yield pd.DataFrame({"total": [total], "n": [n]})

    parts = spark.range(len(sample)).mapInPandas(score, "total double, n bigint")
    return parts.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("silhouette"))


def _cluster_moments(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"c_{c}") for c in columns],
        sum((F.var_pop(c) * F.count(c) for c in columns), F.lit(0.0)).alias("within"))


def calinski_harabasz(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """Between to within dispersion per degree of freedom, from one grouped pass."""
    n = F.sum("n")
    # between = sum n_k (c_k - c)^2 = sum n_k c_k^2 - n c^2
    between = sum((F.sum(F.col("n") * F.pow(f"c_{c}", F.lit(2))) - F.pow(F.sum(F.col("n") * F.col(f"c_{c}")), F.lit(2)) / n
                   for c in columns), F.lit(0.0))
    k = F.count("*")
    return _cluster_moments(df, columns, cluster).agg(
        k.alias("k"), n.alias("n"),
        F.try_divide(between / (k - 1), F.sum("within") / (n - k)).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """Mean over clusters of the worst (scatter_i + scatter_j) / centroid distance.

    There is one row per cluster after aggregation; the comparison of clusters
    runs on an array of those rows.
    """
    def distance(left, right) -> Column:
        return F.sqrt(sum((F.pow(left(c) - right(c), F.lit(2)) for c in columns), F.lit(0.0)))

    centroids = df.groupBy(cluster).agg(*[F.avg(c).alias(f"c_{c}") for c in columns])
    centres = centroids.select(F.collect_list(F.struct(F.col(cluster).alias("k"), *[f"c_{c}" for c in columns]))).scalar()
    own = F.filter("_centres", lambda o: o["k"].eqNullSafe(F.col(cluster)))[0]  # one entry a cluster, looked up, not joined
    placed = df.select(cluster, *columns).withColumn("_centres", centres).withColumn("_own", own)
    scatter = materialize(placed.groupBy(cluster).agg(
        F.avg(distance(lambda c: F.col(c), lambda c: F.col(f"_own.c_{c}"))).alias("s"),
        *[F.first(f"_own.c_{c}").alias(f"c_{c}") for c in columns]))
    everyone = scatter.select(F.collect_list(F.struct(F.col(cluster).alias("k"), "s", *[f"c_{c}" for c in columns]))).scalar()
    worst = F.array_max(F.transform(
        F.filter("_all", lambda o: ~o["k"].eqNullSafe(F.col(cluster))),
        lambda o: F.try_divide(F.col("s") + o["s"], distance(lambda c: F.col(f"c_{c}"), lambda c: o[f"c_{c}"]))))
    return scatter.withColumn("_all", everyone).agg(F.count("*").alias("k"), F.avg(worst).alias("davies_bouldin"))
