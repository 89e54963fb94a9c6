"""Clustering, supervised models, scoring of new batches and streaming.

Fits that other engines cannot repeat exactly have no oracle; their inputs are
whole tables all the same. Ensemble sizes and restarts are the operators' defaults.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import bindings as b
from checks.registry import query
from ledgerlens.functions.likelihood import mean_log_likelihood
from ledgerlens.functions.order import global_row_number, ntile_bucket
from ledgerlens.functions.scalars import minus_days
from ledgerlens.operators import boosting, btyd, clean, cluster, density, explain, features, learning, metrics, mixture
from ledgerlens.plans import early_warning, scoring, training
from ledgerlens.session import materialize
from ledgerlens.sources import artifacts
from ledgerlens.streaming.score_stream import stream_score_append

Z = ["z_recency", "z_frequency", "z_monetary"]
COEFS = {"international_plan": 1.4, "number_customer_service_calls": 0.35, "total_day_minutes": 0.002, "voice_mail_plan": -0.7}


# ---- clustering

@query("standardize", f"SELECT customer_key, {', '.join(f'round({c}, 5) AS {c}' for c in Z)} FROM pairs", doubles=" ".join(Z))
def _(spark, sf):
    z = cluster.standardize(b.rfm_base(spark, sf), ["recency", "frequency", "monetary"])
    return z.select(F.col("customer_id").cast("bigint").alias("customer_key"), *[F.round(c, 5).alias(c) for c in Z])


_GAP = "sqrt(" + " + ".join(f"pow(p.{c} - o.{c}, 2)" for c in Z) + ")"


@query("silhouette", f"""
WITH toward AS (SELECT p.customer_key, p.cluster AS own, o.cluster AS other, sum({_GAP[5:-1]}) AS total, count(*) AS n FROM pairs p, pairs o GROUP BY 1, 2, 3),
     scored AS (SELECT customer_key, max(CASE WHEN own = other THEN n END) AS size,
                       max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM toward GROUP BY 1)
SELECT count(*) AS n, avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM scored""", doubles="silhouette")
def _(spark, sf):
    return cluster.silhouette(b.scaled(spark, sf), Z, "cluster")


@query("calinski_harabasz", f"""
WITH c AS (SELECT cluster, count(*) AS n_k, {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) * count(*) AS w_{c}' for c in Z)} FROM pairs GROUP BY cluster),
     g AS (SELECT {', '.join(f'avg({c}) AS g_{c}' for c in Z)} FROM pairs)
SELECT count(*) AS k, CAST(sum(n_k) AS BIGINT) AS n,
       (sum(n_k * ({' + '.join(f'pow(m_{c} - g_{c}, 2)' for c in Z)})) / (count(*) - 1)) / (sum({' + '.join(f'w_{c}' for c in Z)}) / (sum(n_k) - count(*))) AS calinski_harabasz
FROM c, g""", doubles="calinski_harabasz")
def _(spark, sf):
    return cluster.calinski_harabasz(b.scaled(spark, sf), Z, "cluster")


@query("davies_bouldin", f"""
WITH c AS (SELECT cluster, {', '.join(f'avg({c}) AS {c}' for c in Z)} FROM pairs GROUP BY cluster),
     s AS (SELECT o.cluster, any_value(o.z_recency) AS z_recency, any_value(o.z_frequency) AS z_frequency, any_value(o.z_monetary) AS z_monetary,
                  avg({_GAP}) AS spread FROM pairs p JOIN c o ON p.cluster = o.cluster GROUP BY o.cluster)
SELECT count(*) AS k, avg(worst) AS davies_bouldin
FROM (SELECT p.cluster, max((p.spread + o.spread) / {_GAP}) AS worst FROM s p JOIN s o ON p.cluster <> o.cluster GROUP BY p.cluster)""",
       doubles="davies_bouldin")
def _(spark, sf):
    return cluster.davies_bouldin(b.scaled(spark, sf), Z, "cluster")


@query("cluster_profile", """
SELECT cluster, count(*) AS n, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency, avg(monetary) AS avg_monetary, avg(rfm_score) AS avg_rfm_score
FROM customers JOIN (SELECT CAST(customer_key AS VARCHAR) AS customer_id, cluster FROM pairs) USING (customer_id) GROUP BY cluster""",
       doubles="avg_recency avg_frequency avg_monetary avg_rfm_score")
def _(spark, sf):
    labels = b.scaled(spark, sf).select("customer_id", "cluster")
    return cluster.cluster_profile(b.rfm_scored(spark, sf).join(labels, "customer_id"))


@query("cluster_tier_label", """
SELECT customer_id, cluster, CASE place WHEN 1 THEN 'High Value' WHEN 2 THEN 'Mid-High' WHEN 3 THEN 'Mid-Low' ELSE 'Low Value' END AS km_label
FROM (SELECT customer_id, cluster, dense_rank() OVER (ORDER BY s DESC) AS place
      FROM (SELECT customer_id, cluster, avg(rfm_score) OVER (PARTITION BY cluster) AS s
            FROM customers JOIN (SELECT CAST(customer_key AS VARCHAR) AS customer_id, cluster FROM pairs) USING (customer_id)))""")
def _(spark, sf):
    labels = b.scaled(spark, sf).select("customer_id", "cluster")
    return cluster.cluster_tier_label(b.rfm_scored(spark, sf).join(labels, "customer_id"), "cluster").select(
        "customer_id", "cluster", "km_label")


def _vectors(spark, sf):
    return cluster.assemble(b.scaled(spark, sf).drop("cluster"), Z)


def _cost(rows, label):
    """Squared distances to the mean of each group."""
    return sum((F.var_pop(z) * F.count(z) for z in Z), F.lit(0.0)), rows.groupBy(label)


@query("kmeans_scan", "SELECT k::INTEGER AS k, true AS cost_falls, true AS below_bands FROM range(2, 9) AS t(k)")
def _(spark, sf):
    """Costs fall with K, and each is below that of K equal bands of recency, the best single measure to cut by."""
    vectors = _vectors(spark, sf)
    scan = cluster.kmeans_scan(spark, vectors).orderBy("k").collect()
    placed = materialize(global_row_number(b.scaled(spark, sf).select(*Z, "customer_key"), ["z_recency", "customer_key"]))
    n = F.lit(placed.count())
    rows, before = [], float("inf")
    for r in scan:
        within, grouped = _cost(placed.withColumn("band", ntile_bucket(F.col("row_no"), n, r["k"])), "band")
        rows.append((r["k"], r["wcss"] < before, r["wcss"] <= grouped.agg(within.alias("c")).agg(F.sum("c")).first()[0]))
        before = r["wcss"]
    return spark.createDataFrame(rows, "k int, cost_falls boolean, below_bands boolean")


@query("kmeans_fit", "SELECT customer_id, true AS in_range, true AS at_nearest_centre, true AS centre_is_mean, true AS cost_is_recomputed, true AS below_rule FROM rfm_base")
def _(spark, sf):
    """Every customer has the label of the nearest centre; each centre is the mean of its customers; the cost is what the
    labels cost, and not above that of the labels by rule."""
    vectors = _vectors(spark, sf)
    model = cluster.kmeans_fit(vectors, 4)
    gaps = F.array(*[sum((F.pow(F.col(z) - float(x), F.lit(2)) for z, x in zip(Z, centre)), F.lit(0.0)) for centre in model.centres])
    own = F.element_at(gaps, F.col("cluster") + 1)
    placed = materialize(model.transform(vectors))
    means = {r["cluster"]: [r[z] for z in Z] for r in placed.groupBy("cluster").agg(*[F.avg(z).alias(z) for z in Z]).collect()}
    is_mean = all(np.allclose(means[i], c, atol=1e-5) for i, c in enumerate(model.centres) if i in means)
    costs = [grouped.agg(within.alias("c")).agg(F.sum("c")).first()[0] for within, grouped in (
        _cost(placed, "cluster"), _cost(b.scaled(spark, sf), "cluster"))]
    return placed.select(
        "customer_id", F.col("cluster").between(0, 3).alias("in_range"), (own <= F.array_min(gaps) + 1e-9).alias("at_nearest_centre"),
        F.lit(bool(is_mean)).alias("centre_is_mean"), F.lit(bool(abs(costs[0] - model.cost) <= 1e-6 * (1 + costs[0]))).alias("cost_is_recomputed"),
        F.lit(bool(model.cost <= costs[1] + 1e-9)).alias("below_rule"))


@query("gmm_scan", "SELECT k::INTEGER AS k, true AS rests, true AS criteria_follow FROM range(2, 7) AS t(k)")
def _(spark, sf):
    """A further step moves no likelihood by 1e-6; BIC and AIC follow from the likelihood that Spark SQL finds at the returned parameters."""
    vectors = _vectors(spark, sf)
    models = mixture.fit_all(vectors, list(range(2, 7)), 5, 42)
    table = {r["k"]: r for r in cluster.criteria_table(spark, models).collect()}
    rows = []
    for k, m in models.items():
        densities = []
        for w, centre, c in zip(m.weights, m.means, m.covariances):
            inverse = np.linalg.inv(c)
            form = sum(((F.col(Z[i]) - float(centre[i])) * (F.col(Z[j]) - float(centre[j])) * float(inverse[i, j]) for i in range(3) for j in range(3)), F.lit(0.0))
            densities.append(F.lit(float(w / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(c)))) * F.exp(-0.5 * form))
        total, n = b.scaled(spark, sf).agg(F.sum(F.log(sum(densities, F.lit(0.0)))), F.count("*")).first()
        free = 3 * k + 6 * k + k - 1
        follows = abs(table[k]["bic"] - (-2 * total + free * np.log(n))) < 1e-4 and abs(table[k]["aic"] - (-2 * total + 2 * free)) < 1e-4
        rows.append((k, bool(abs(m.step) < 1e-6), bool(follows)))
    return spark.createDataFrame(rows, "k int, rests boolean, criteria_follow boolean")


def _mixture(spark, sf):
    return b.stored(spark, sf, "mixture", lambda s, d: cluster.gmm_fit_certainty(_vectors(s, d), 3).drop("features"))


@query("gmm_fit_certainty", "SELECT customer_id, true AS sums_to_one, true AS most_likely, true AS all_have_members FROM rfm_base")
def _(spark, sf):
    """Memberships sum to one; the cluster is the most likely one and the certainty its membership; every
    component has members."""
    rows = _mixture(spark, sf)
    total = F.aggregate("membership", F.lit(0.0), lambda a, x: a + x)
    own = F.element_at("membership", F.col("gmm_cluster") + 1)
    means = rows.agg(*[F.sum(F.col("membership")[j]).alias(f"n{j}") for j in range(3)]).first()
    return rows.select(
        "customer_id", (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        ((own == F.col("certainty")) & (F.col("certainty") >= 1 / 3 - 1e-9)).alias("most_likely"), F.lit(min(means) > 0).alias("all_have_members"))


@query("gmm_certainty_summary")
def _(spark, sf):
    return cluster.certainty_summary(_mixture(spark, sf))


def _distances(spark, sf):
    return b.stored(spark, sf, "neighbors", lambda s, d: density.kth_neighbor_distance(b.scaled(s, d), Z, "customer_key"))


@query("kth_neighbor_distance", "SELECT customer_key, round(kth_distance, 6) AS kth_distance FROM neighbors", doubles="kth_distance")
def _(spark, sf):
    return density.kth_neighbor_distance(b.scaled(spark, sf), Z, "customer_key").withColumn(
        "kth_distance", F.round("kth_distance", 6))


@query("density_viability", """
SELECT round(min(d), 6) AS min, round(quantile_cont(d, 0.25), 6) AS p25, round(median(d), 6) AS median, round(quantile_cont(d, 0.75), 6) AS p75,
       round(max(d), 6) AS max, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 6) AS iqr,
       avg(CASE WHEN d < lo + 0.20e0 * (hi - lo) THEN 1 ELSE 0 END) * 100 AS near_min_pct,
       avg(CASE WHEN d < lo + 0.20e0 * (hi - lo) THEN 1 ELSE 0 END) * 100 <= 60 AS viable
FROM (SELECT kth_distance AS d FROM neighbors), (SELECT min(kth_distance) AS lo, max(kth_distance) AS hi FROM neighbors)""",
       doubles="min p25 median p75 max iqr near_min_pct")
def _(spark, sf):
    v = density.density_viability(_distances(spark, sf))
    return v.select(*[F.round(c, 6).alias(c) for c in ("min", "p25", "median", "p75", "max", "iqr")], "near_min_pct", "viable")


@query("knee_detect", """
WITH k AS (SELECT row_number() OVER (ORDER BY kth_distance DESC, customer_key) - 1 AS i, kth_distance AS v FROM neighbors),
     s AS (SELECT i, v, CASE WHEN count(*) OVER w = 10 THEN avg(v) OVER w END AS s FROM k WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
     d AS (SELECT i, lead(v) OVER (ORDER BY i) AS next, lead(s, 2) OVER (ORDER BY i) - 2 * lead(s) OVER (ORDER BY i) + s AS d2 FROM s)
SELECT i + 1 AS knee_index, round(next, 6) AS knee_value FROM d WHERE d2 IS NOT NULL ORDER BY d2 DESC, i LIMIT 1""", doubles="knee_value")
def _(spark, sf):
    return density.knee_detect(_distances(spark, sf), key="customer_key").withColumn("knee_value", F.round("knee_value", 6))


# ---- supervised models on subscribers

def _prepared(spark, sf):
    return b.stored(spark, sf, "prepared", lambda s, d: early_warning.prepare_subscribers(b.subscribers(s, d)))


def _split(spark, sf):
    split = metrics.stratified_split(_prepared(spark, sf).withColumnRenamed("churn", "label"), "subscriber_key")
    split = materialize(split)
    return split.where("is_train"), split.where("NOT is_train")


LOGIT_FEATURES = early_warning.MODEL_FEATURES
LOGIT_CATEGORIES = ("state", "area_code")
NATIONS = [f"NATION_{i}" for i in range(25)]


@query("one_hot_encode", "SELECT subscriber_key, " + ", ".join(
    [f"CAST(area_code = '{i}' AS INTEGER) AS area_code_{i}" for i in range(25)] + [f"CAST(state = '{n}' AS INTEGER) AS \"state_{n}\"" for n in NATIONS]) + " FROM subscribers")
def _(spark, sf):
    return learning.one_hot_encode(b.subscribers(spark, sf).select("subscriber_key", "area_code", "state"), ["area_code", "state"])


def _with_categories(spark, sf):
    """Training and test rows with all inputs, categories included."""
    def build(s, d):
        rows = clean.map_binary(b.subscribers(s, d), ["international_plan", "voice_mail_plan", "churn"])
        return metrics.stratified_split(rows.withColumnRenamed("churn", "label"), "subscriber_key")

    split = b.stored(spark, sf, "with_categories", build)
    return split.where("is_train"), split.where("NOT is_train")


_LOGITS: dict[tuple[str, str], object] = {}


def _logit(spark, sf):
    """The full model, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LOGITS:
        _LOGITS[key] = learning.fit_logit(_with_categories(spark, sf)[0], LOGIT_FEATURES, categories=LOGIT_CATEGORIES)
    return _LOGITS[key]


@query("logit_inference", " UNION ALL ".join(f"SELECT '{c}' AS feature, true AS score_equation_holds" for c in (*LOGIT_FEATURES, "const")) +
       " UNION ALL SELECT DISTINCT 'state_' || state, true FROM subscribers UNION ALL SELECT DISTINCT 'area_code_' || area_code, true FROM subscribers")
def _(spark, sf):
    """At the estimate the residuals are orthogonal to every term, kept or aliased."""
    model = _logit(spark, sf)
    named = [r["feature"] for r in learning.coefficient_table(spark, model).select("feature").collect()]
    scored = model.transform(_with_categories(spark, sf)[0]).withColumn("residual", F.col("label").cast("double") - F.col("probability"))
    size = {c: F.col(c).cast("double") for c in LOGIT_FEATURES} | {"const": F.lit(1.0)}
    wide = scored.agg(*[(F.abs(F.sum(F.col("residual") * x)) <= 1e-5 * (1 + F.sum(F.abs(x)))).alias(c) for c, x in size.items()])
    rows = wide.unpivot([], list(size), "feature", "score_equation_holds")
    for c in LOGIT_CATEGORIES:
        rows = rows.union(scored.groupBy(c).agg((F.abs(F.sum("residual")) <= 1e-5 * (1 + F.count("*"))).alias("holds")).select(F.concat(F.lit(f"{c}_"), c), "holds"))
    return rows.where(F.col("feature").isin(named))


@query("logit_reduced")
def _(spark, sf):
    return learning.logit_reduced(*_with_categories(spark, sf), LOGIT_FEATURES, categories=LOGIT_CATEGORIES)


@query("logit_effects")
def _(spark, sf):
    return learning.effect_text(learning.coefficient_table(spark, _logit(spark, sf)))


@query("what_if_probability")
def _(spark, sf):
    return learning.what_if_probability(
        _logit(spark, sf), _with_categories(spark, sf)[1], LOGIT_FEATURES,
        {"international_plan": (0, 1), "number_customer_service_calls": (0, 4)}, LOGIT_CATEGORIES)


_CHURN_MODELS: dict[tuple[str, str], object] = {}


def _churn_model(spark, sf):
    """The classifier fitted on the training rows, once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CHURN_MODELS:
        _CHURN_MODELS[key] = learning.boosted_classifier(_split(spark, sf)[0], early_warning.MODEL_FEATURES)
    return _CHURN_MODELS[key]


@query("boosted_classifier")
def _(spark, sf):
    scored = learning.positive_probability(_churn_model(spark, sf).transform(_split(spark, sf)[1]), "score")
    return metrics.classification_metrics(scored, "label", "score")


@query("tree_importance")
def _(spark, sf):
    return learning.tree_importance(_churn_model(spark, sf), early_warning.MODEL_FEATURES, spark)


@query("tree_contributions", "SELECT subscriber_key, 12::BIGINT AS n_features, true AS adds_up FROM subscribers")
def _(spark, sf):
    """The contributions of all features and the base value add up to the raw score of every subscriber."""
    model = _churn_model(spark, sf)
    scored = model.transform(_prepared(spark, sf)).select("subscriber_key", "margin")
    parts = explain.tree_contributions(_prepared(spark, sf), model, ["subscriber_key"]).groupBy("subscriber_key").agg(
        F.count("*").alias("n_features"), F.sum("contribution").alias("total"))
    return parts.join(scored, "subscriber_key").select(
        "subscriber_key", "n_features", (F.abs(F.col("total") + explain.base_value(model) - F.col("margin")) < 1e-6).alias("adds_up"))


@query("tree_contributions_global")
def _(spark, sf):
    """Mean absolute contribution of each input over all subscribers."""
    return explain.tree_importance_global(_prepared(spark, sf), _churn_model(spark, sf))


@query("early_warning")
def _(spark, sf):
    model = early_warning.train_churn_model(_prepared(spark, sf))
    return early_warning.warn(b.subscribers(spark, sf), model, order_by=["subscriber_key"]).select(
        "customer_id", "subscriber_key", "churn_probability_pct", "risk_tier", "monthly_value")


def _model_table(spark, sf):
    def build(s, d):
        tx = b.retail(s, d)
        history, future = clean.temporal_split(tx)
        t0 = minus_days(clean.snapshot_of(tx), 90)
        return features.left_join_labels(features.left_join_features_fill0(history, t0), features.targets_90d(future))

    return b.stored(spark, sf, "model_table", build)


@query("tweedie_regression")
def _(spark, sf):
    """Error and deviance of the linear and the boosted model on the fifth of the customers that neither has seen."""
    table = materialize(metrics.hash_split(learning.log_features(_model_table(spark, sf), features.FEATURES), F.col("customer_id").cast("bigint")))
    train, held = table.where("is_train"), table.where("NOT is_train")
    linear = learning.tweedie_regression(train, features.FEATURES, "sales_90_value").transform(held)
    boosted = learning.positive_probability(learning.boosted_tweedie(train, features.FEATURES, "sales_90_value").transform(held), "pred_spend")
    rows = []
    for name, scored in (("linear", linear), ("boosted", boosted)):
        scored = scored.select("sales_90_value", "pred_spend")
        rows.append(metrics.regression_metrics(scored, "sales_90_value", "pred_spend").join(
            learning.tweedie_deviance(scored, "sales_90_value", "pred_spend"), "n").select(F.lit(name).alias("model"), "*"))
    return rows[0].union(rows[1])


@query("cross_validate")
def _(spark, sf):
    """Five folds of the spend and of the purchase model: ten models of 400 trees in one scan."""
    table = _model_table(spark, sf).withColumn("key", F.col("customer_id").cast("bigint"))
    table = metrics.fold_column(table, F.col("key")).withColumnRenamed("fold", "spend_fold")
    table = materialize(metrics.stratified_folds(table, "key", "purchased_flag"))
    models = boosting.fit_many(table, features.FEATURES, [
        *learning.fold_specs("sales_90_value", "tweedie", 5, "spend_fold"), *learning.fold_specs("purchased_flag", "logistic")])
    spend = learning.fold_scores(table, models[:5], lambda s: learning.regression_scores(s, "sales_90_value", "prediction"), "spend_fold")
    return spend.unionByName(learning.fold_scores(table, models[5:], lambda s: learning.classification_scores(s, "purchased_flag", "prediction")))


@query("save_load_models", "SELECT subscriber_key, true AS same FROM subscribers")
def _(spark, sf):
    """The reloaded model gives every subscriber the probability of the saved one."""
    everyone = _prepared(spark, sf).withColumnRenamed("churn", "label")
    path = b.scratch(spark, "model")
    model = learning.fit_logit(_split(spark, sf)[0], LOGIT_FEATURES)
    artifacts.save_model(model, path)
    first = model.transform(everyone).select("subscriber_key", F.col("probability").alias("saved"))
    second = artifacts.load_model(path).transform(everyone).select("subscriber_key", "probability")
    return first.join(second, "subscriber_key").select("subscriber_key", (F.col("saved") == F.col("probability")).alias("same"))


_TERMS = {c: f"{v}e0 * ({c} - (SELECT avg({c}) FROM coded))" for c, v in COEFS.items()}
_CODED = """coded AS (SELECT subscriber_key, label, score, CASE lower(international_plan) WHEN 'yes' THEN 1 ELSE 0 END AS international_plan,
       number_customer_service_calls, total_day_minutes, CASE lower(voice_mail_plan) WHEN 'yes' THEN 1 ELSE 0 END AS voice_mail_plan FROM scores)"""


def _coded(spark, sf):
    return clean.map_binary(b.subscriber_scores(spark, sf), ["international_plan", "voice_mail_plan"])


@query("feature_importance_global", f"WITH {_CODED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(abs({t})) AS importance FROM coded" for c, t in _TERMS.items()), doubles="importance")
def _(spark, sf):
    return learning.feature_importance_global(_coded(spark, sf), COEFS)


@query("row_contributions", f"WITH {_CODED} SELECT *, CASE WHEN contribution > 0 THEN 'pushes toward churn' ELSE 'reduces churn risk' END AS direction FROM (" + " UNION ALL ".join(
    f"SELECT subscriber_key, '{c}' AS feature, round({t}, 5) AS contribution FROM coded" for c, t in _TERMS.items()) + ")", doubles="contribution")
def _(spark, sf):
    return learning.row_contributions(_coded(spark, sf), COEFS, ["subscriber_key"]).withColumn(
        "contribution", F.round("contribution", 5))


# ---- probabilistic fits, new batches and the stream

def _at_maximum(params, objective):
    """One row a parameter: moving it by one percent either way does not raise the objective."""
    names, at = list(params), np.array(list(params.values()))
    moved = [at * np.where(np.arange(len(at)) == i, f, 1.0) for i in range(len(at)) for f in (0.99, 1.01)]
    values = objective(np.array([at, *moved]))
    return [(n, bool(max(values[1 + 2 * i], values[2 + 2 * i]) <= values[0] + 1e-6)) for i, n in enumerate(names)]


@query("bgnbd_fit", " UNION ALL ".join(f"SELECT '{p}' AS parameter, true AS at_maximum" for p in ("r", "alpha", "a", "b")))
def _(spark, sf):
    """The penalised likelihood has its maximum at the fitted parameters (time in units of the mean observation)."""
    summary = b.retail_btyd(spark, sf)
    params, scale = btyd.bgnbd_fit(summary), float(summary.agg(F.avg("T")).first()[0])
    scaled = summary.select("x", (F.col("t_x") / scale).alias("t_x"), (F.col("T") / scale).alias("T"), F.lit(1).alias("n"))

    def objective(points):
        own = points / np.array([1.0, scale, 1.0, 1.0])
        return mean_log_likelihood(scaled, btyd._bgnbd_kernel, own, "n") - btyd.PENALIZER * (own ** 2).sum(axis=1)

    return spark.createDataFrame(_at_maximum(params, objective), "parameter string, at_maximum boolean")


@query("gamma_gamma_fit", " UNION ALL ".join(f"SELECT '{p}' AS parameter, true AS at_maximum" for p in ("p", "q", "v")))
def _(spark, sf):
    """The same for the spend model (money in units of its mean)."""
    buyers = btyd.repeat_buyers(b.retail_btyd(spark, sf))
    params, scale = btyd.gamma_gamma_fit(b.retail_btyd(spark, sf)), float(buyers.agg(F.avg("m")).first()[0])
    scaled = buyers.select("x", (F.col("m") / scale).alias("m"), F.lit(1).alias("n"))

    def objective(points):
        own = points / np.array([1.0, 1.0, scale])
        return mean_log_likelihood(scaled, btyd._gamma_gamma_kernel, own, "n") - btyd.PENALIZER * (own ** 2).sum(axis=1)

    return spark.createDataFrame(_at_maximum(params, objective), "parameter string, at_maximum boolean")


_TRAINED: dict[tuple[str, str, bool], training.StoredModels] = {}


def _trained(spark, sf, everything: bool = False) -> training.StoredModels:
    """Models trained on all transactions, or on those before 2001 where later ones arrive as batches."""
    key = (spark.sparkContext.applicationId, sf, everything)
    if key not in _TRAINED:
        raw = b.transactions(spark, sf)
        raw = raw if everything else raw.where(F.year("invoice_ts") < 2001)
        _TRAINED[key] = training.train_customer_models(raw, b.scratch(spark, "train"))
    return _TRAINED[key]


_TOLD = ("customer_id", "frequency", "n_orders", "recency", "total_spend", "r_score", "f_score", "m_score", "rfm_score", "segment")


@query("train_customer_models", f"SELECT {', '.join(_TOLD)} FROM customers", doubles="total_spend")
def _(spark, sf):
    """The stored table without the columns of fitted models."""
    return artifacts.read_customer_table(spark, _trained(spark, sf, everything=True).customer_table).select(*_TOLD)


@query("score_new_batch", """
SELECT customer_id, count(DISTINCT invoice) AS n_orders, sum(order_value) AS total_spend,
       CAST(floor((epoch_us((SELECT max(invoice_ts) FROM clean_tx)) - epoch_us(max(invoice_ts))) / 86400000000.0) AS BIGINT) AS recency
FROM clean_tx WHERE customer_id IN (SELECT customer_id FROM clean_tx WHERE year(invoice_ts) >= 2001) GROUP BY customer_id""", doubles="total_spend")
def _(spark, sf):
    """Customers of the late lines with all their lines, without the columns of fitted models."""
    late = b.transactions(spark, sf).where(F.year("invoice_ts") >= 2001)
    return scoring.score_new_batch(late, _trained(spark, sf)).select("customer_id", "n_orders", "total_spend", "recency")


@query("stream_score_append", """
WITH early AS (SELECT customer_id, avg(order_value) AS v, avg(quantity) AS q FROM clean_tx WHERE year(invoice_ts) < 2001 GROUP BY customer_id),
     fences AS (SELECT quantile_cont(v, 0.75) + 3 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS top_v,
                       quantile_cont(q, 0.75) + 3 * (quantile_cont(q, 0.75) - quantile_cont(q, 0.25)) AS top_q FROM early),
     held AS (SELECT customer_id FROM early, fences WHERE v <= top_v AND q <= top_q
              UNION SELECT customer_id FROM clean_tx WHERE year(invoice_ts) >= 2001)
SELECT customer_id, count(DISTINCT invoice) AS n_orders, sum(order_value) AS total_spend
FROM clean_tx WHERE customer_id IN (SELECT customer_id FROM held) GROUP BY customer_id""", doubles="total_spend")
def _(spark, sf):
    """Transactions of 2001 arrive as quarterly files and are folded into a copy of the trained table."""
    trained = _trained(spark, sf)
    folder = b.scratch(spark, "stream")
    models = trained.at(folder)
    for part in ("customers", "transactions"):
        artifacts.write_batch(spark.read.parquet(f"{trained.folder}/{part}/batch_id=0"), f"{folder}/{part}", 0)
    spark.read.parquet(trained.cuts).write.parquet(models.cuts)
    late = materialize(b.transactions(spark, sf).where(F.year("invoice_ts") >= 2001))  # joined once, not for each quarter
    for q in (1, 2, 3, 4):  # a file a quarter, not one for each task of the join
        late.where(F.quarter("invoice_ts") == q).coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")
    stream_score_append(spark, f"{folder}/arrivals", models, f"{folder}/progress", files_per_batch=8).awaitTermination()
    return artifacts.read_customer_table(spark, models.customer_table).select("customer_id", "n_orders", "total_spend")
