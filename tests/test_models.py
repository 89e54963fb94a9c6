import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import boosting, cluster, density, learning, metrics
from ledgerlens.plans import early_warning


def brute_kth(points, k=5):
    gap = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    return np.sort(gap, axis=1)[:, k - 1]


@pytest.mark.parametrize("leaf", [8, 60, 5000])
def test_neighbour_distances_are_exact_with_clumps_and_copies(spark, leaf):
    rng = np.random.default_rng(11)
    spread = rng.normal(0, 3, (250, 3))
    clump = rng.normal(10, 0.01, (150, 3))
    copies = np.repeat([[1.0, 1.0, 1.0]], 200, axis=0)
    grid = np.stack([rng.integers(0, 3, 60), np.zeros(60), rng.integers(0, 2, 60)], axis=1)  # few distinct values
    lonely = np.array([[500.0, 500.0, -500.0]])
    points = np.vstack([spread, clump, copies, grid, lonely]).astype(float)
    pdf = pd.DataFrame(points, columns=["a", "b", "c"]).assign(id=range(len(points)))
    got = density.kth_neighbor_distance(spark.createDataFrame(pdf), ["a", "b", "c"], "id", leaf_points=leaf).toPandas().sort_values("id")
    assert len(got) == len(points)
    assert got.kth_distance.to_numpy() == pytest.approx(brute_kth(points), abs=1e-9)


def test_many_queries_to_one_region_are_split(spark, monkeypatch):
    monkeypatch.setattr(density, "QUERIES_PER_CHUNK", 5)
    points = np.random.default_rng(2).normal(size=(400, 2))
    pdf = pd.DataFrame(points, columns=["a", "b"]).assign(id=range(400))
    got = density.kth_neighbor_distance(spark.createDataFrame(pdf), ["a", "b"], "id", leaf_points=10).toPandas().sort_values("id")
    assert got.kth_distance.to_numpy() == pytest.approx(brute_kth(points), abs=1e-9)


@pytest.mark.parametrize("depth", [2, 8])
def test_over_full_regions_are_cut_again(spark, monkeypatch, depth):
    monkeypatch.setattr(density, "ROUND_DEPTH", depth)
    monkeypatch.setattr(density, "SAMPLE_PER_LEAF", 4)  # planes of a poor sample
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(size=(300, 2)), rng.normal(5, 1e-6, (200, 2)), np.stack([np.full(100, 2.0), np.arange(100)], axis=1)])
    pdf = pd.DataFrame(points, columns=["a", "b"]).assign(id=range(600))
    df = spark.createDataFrame(pdf)
    placed, rounds = density._regions(df, ["a", "b"], 16)
    assert placed.count() == 600 and placed.groupBy("region").count().agg(F.max("count")).first()[0] <= 16
    assert len(rounds) >= 6 // depth
    got = density.kth_neighbor_distance(df, ["a", "b"], "id", leaf_points=16).toPandas().sort_values("id")
    assert got.kth_distance.to_numpy() == pytest.approx(brute_kth(points), abs=1e-9)


def test_regions_that_cannot_be_told_apart_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(density, "ROUND_DEPTH", 40)
    monkeypatch.setattr(density, "_split_planes", lambda rows, depth: (np.zeros(3, np.int32), np.full(3, np.inf)))
    df = spark.createDataFrame([(float(i),) for i in range(9)], "a double")
    with pytest.raises(RuntimeError, match="after 1 round"):
        density._regions(df, ["a"], 5)


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id int, a double")
    assert [r["kth_distance"] for r in density.kth_neighbor_distance(df, ["a"], "id").collect()] == [None, None]


@pytest.mark.parametrize("block", [7, 12, 1_000_000])
def test_knee_matches_the_array_definition(spark, block):
    values = np.sort(np.random.default_rng(4).gamma(0.5, 2.0, 90))[::-1]
    smooth = np.convolve(values, np.ones(10) / 10, mode="valid")
    knee = int(np.argmax(np.diff(np.diff(smooth)))) + 1
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "customer_id int, kth_distance double")
    if block < 11:
        block = 11  # a block must hold the rows it lends to its neighbour
    row = density.knee_detect(df, block=block).first()
    assert row["knee_index"] == knee and row["knee_value"] == pytest.approx(values[knee])


def test_auc_edge_cases(spark):
    def auc(rows):
        return metrics.roc_auc(spark.createDataFrame(rows, "label int, score double")).first()["auc"]
    assert auc([(0, 0.5), (1, 0.5), (1, 0.5)]) == 0.5
    assert auc([(0, 0.1), (1, 0.9)]) == 1.0
    assert auc([(1, 0.1), (1, 0.9)]) is None


def test_auc_against_pairs_and_the_evaluator(spark):
    rng = np.random.default_rng(8)
    label, score = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2)
    df = spark.createDataFrame(pd.DataFrame({"label": label, "score": score}))
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(want)
    assert learning.exact_auc(df, "score") == pytest.approx(want)


def test_youden_takes_the_highest_of_tied_thresholds(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    row = metrics.youden_threshold(df).first()
    assert row["threshold"] == 0.9 and row["youden_j"] == 0.5 and row["f1_default"] == pytest.approx(0.8)


def test_metrics_without_positives(spark):
    row = metrics.classification_metrics(spark.createDataFrame([(0, 0.1)], "label int, score double")).first()
    assert row["precision"] == 0.0 and row["accuracy"] == 1.0


@pytest.mark.parametrize("partitions", [1, 9])
def test_stratified_split_keeps_class_shares(spark, partitions):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int")).repartition(partitions)
    got = {(r["label"], r["is_train"]): r["count"] for r in metrics.stratified_split(df, "id").groupBy("label", "is_train").count().collect()}
    assert got == {(0, True): 720, (0, False): 180, (1, True): 80, (1, False): 20}


def test_class_weight_balances(spark):
    df = metrics.class_weight(spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int"))
    assert df.groupBy("label").agg(F.sum("weight").alias("w")).select(F.collect_set("w")).first()[0] == [3.0]


def test_cluster_indices(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(6, 1, (30, 2))])
    labels = np.repeat([0, 1], 30)
    df = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b"]).assign(cluster=labels, id=range(60)))
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    inner = np.array([gap[i, labels == labels[i]].sum() / 29 for i in range(60)])
    outer = np.array([gap[i, labels != labels[i]].mean() for i in range(60)])
    want = ((outer - inner) / np.maximum(outer, inner)).mean()
    row = cluster.silhouette_sample(df, ["a", "b"], "cluster", "id", max_rows=100_000).first()
    assert row["n"] == 60 and row["silhouette"] == pytest.approx(want)
    assert cluster.silhouette_sample(df.limit(0), ["a", "b"], "cluster", "id", 50).first()["silhouette"] is None
    squared = gap ** 2
    inner = np.array([squared[i, labels == labels[i]].sum() / 29 for i in range(60)])
    outer = np.array([squared[i, labels != labels[i]].mean() for i in range(60)])
    row = cluster.silhouette(df, ["a", "b"], "cluster").first()
    assert row["n"] == 60 and row["silhouette"] == pytest.approx(((outer - inner) / np.maximum(outer, inner)).mean())
    assert cluster.silhouette(df.limit(0), ["a", "b"], "cluster").first()["silhouette"] is None


def test_null_cluster_label_is_a_cluster(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1), (9.0, None), (10.0, None)], "a double, cluster int")
    named = df.fillna({"cluster": 2})
    assert cluster.silhouette(df, ["a"], "cluster").first() == cluster.silhouette(named, ["a"], "cluster").first()
    assert cluster.davies_bouldin(df, ["a"], "cluster").first() == cluster.davies_bouldin(named, ["a"], "cluster").first()


def test_null_coordinate_keeps_its_row(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0), (4, 3.0, 0.0)], "id int, a double, b double")
    got = {r["id"]: r["kth_distance"] for r in density.kth_neighbor_distance(df, ["a", "b"], "id", 2).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: 2.0}


def test_null_labels_are_split_like_a_class(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "id int, label int")
    counts = {(r["label"], r["is_train"]): r["count"] for r in metrics.stratified_split(df, "id").groupBy("label", "is_train").count().collect()}
    assert counts == {(None, True): 16, (None, False): 4, (0, True): 32, (0, False): 8, (1, True): 32, (1, False): 8}
    assert metrics.stratified_folds(df, "id").count() == 100


def test_sparse_levels_have_no_limit(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(1500)], "id int, c string")
    out = learning.one_hot_encode(df, ["c"], sparse=True)
    assert out.columns == ["id", "c_vec"] and out.count() == 1500 and out.first()["c_vec"].size >= 1500


def test_constant_column_standardises_to_zero(spark):
    df = cluster.standardize(spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], ["a", "b"]), ["a", "b"])
    assert [(r["z_a"], r["z_b"]) for r in df.orderBy("b").collect()] == [(0.0, -1.0), (0.0, 1.0)]


def test_too_many_clusters_for_the_names(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "km_cluster int, rfm_score double")
    with pytest.raises(ValueError):
        cluster.cluster_tier_label(df)
    named = cluster.cluster_tier_label(df.where("km_cluster < 4")).orderBy("km_cluster").collect()
    assert [r["km_label"] for r in named] == ["Low Value", "Mid-Low", "Mid-High", "High Value"]


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    n = 600
    x1, x2, noise = rng.normal(size=n), rng.integers(0, 2, n), rng.normal(size=n)
    p = 1 / (1 + np.exp(-(2.0 * x1 + 1.5 * x2 - 1.0)))
    label = (rng.random(n) < p).astype(int)
    return spark.createDataFrame(pd.DataFrame({"id": range(n), "x1": x1, "x2": x2.astype(float), "noise": noise, "label": label})).cache()


def best_auc(df):
    """AUC of the true log-odds, which no model can exceed by much."""
    return learning.exact_auc(df.withColumn("truth", 2.0 * F.col("x1") + 1.5 * F.col("x2")), "truth")


def test_logit_recovers_effects(separable):
    table = {r["feature"]: r for r in learning.logit_inference(separable, ["x1", "x2", "noise"]).collect()}
    assert table["x1"]["coef"] == pytest.approx(2.0, abs=0.5) and table["x1"]["significant"] and not table["noise"]["significant"]
    assert table["x1"]["ci_low"] < table["x1"]["coef"] < table["x1"]["ci_high"] and 0 < table["const"]["pseudo_r2"] < 1
    reduced = {r["model"]: r for r in learning.logit_reduced(separable, separable, ["x1", "x2", "noise"]).collect()}
    assert reduced["reduced"]["n_features"] == 2 and reduced["reduced"]["auc"] > best_auc(separable) - 0.02


def test_what_if_moves_in_the_right_direction(separable):
    model = learning.fit_logit(separable, ["x1", "x2"])
    rows = learning.what_if_probability(model, separable, ["x1", "x2"], {"x2": (0, 1), "absent": (1,)}).orderBy("set_to").collect()
    assert len(rows) == 2 and rows[0]["probability"] < rows[1]["probability"]


def test_boosted_trees_rank_and_explain(spark, separable):
    model = learning.boosted_classifier(separable, ["x1", "x2", "noise"], trees=8, depth=3)
    scored = learning.positive_probability(model.transform(separable), "score")
    assert learning.exact_auc(scored, "score") > best_auc(separable) - 0.02
    assert learning.tree_importance(model, ["x1", "x2", "noise"], spark).first()["feature"] == "x1"


def test_linear_contributions_sum_to_the_log_odds(separable):
    coefs = {"x1": 2.0, "x2": 1.5}
    parts = learning.row_contributions(separable, coefs, ["id"]).groupBy("id").agg(F.sum("contribution").alias("s"))
    means = separable.agg(F.avg("x1"), F.avg("x2")).first()
    joined = parts.join(separable, "id").withColumn("want", 2.0 * (F.col("x1") - means[0]) + 1.5 * (F.col("x2") - means[1]))
    assert joined.where(F.abs(F.col("s") - F.col("want")) > 1e-9).count() == 0


def test_tweedie_handles_zeros(spark):
    rng = np.random.default_rng(6)
    n = 800
    x = rng.gamma(2.0, 50.0, n)
    y = np.where(rng.random(n) < 0.6, 0.0, x * rng.gamma(5.0, 0.2, n))
    df = learning.log_features(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), ["x"])
    scored = learning.tweedie_regression(df, ["x"], "y").transform(df)
    stats = scored.agg(F.min("pred_spend"), F.avg("pred_spend"), F.corr("pred_spend", "y")).first()
    assert stats[0] >= 0 and stats[1] == pytest.approx(y.mean(), rel=0.1) and stats[2] > 0.2


def test_cross_validation_covers_every_row(separable):
    folded = metrics.stratified_folds(separable, "id")
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert sum(sizes) == 600 and max(sizes) - min(sizes) <= 2
    result = learning.cross_validate(
        folded, lambda train: learning.fit_logit(train, ["x1", "x2"]).transform,
        lambda s: learning.classification_scores(s, "label", "probability"))
    by = {r["metric"]: r for r in result.collect()}
    assert by["auc"]["mean"] > best_auc(separable) - 0.02 and by["auc"]["folds"] == 5 and by["f1"]["sd"] >= 0


def test_one_hot(spark):
    df = learning.one_hot_encode(spark.createDataFrame([("a",), ("b",), (None,)], "c string"), ["c"])
    assert sorted(tuple(r) for r in df.collect()) == [(0, 0), (0, 1), (1, 0)]


def test_early_warning_accepts_titles_and_makes_ids(spark):
    rng = np.random.default_rng(3)
    n = 120
    data = {f: rng.random(n) * 100 for f in early_warning.MODEL_FEATURES}
    data["international_plan"] = np.where(rng.random(n) < 0.4, "Yes", "no")
    data["voice_mail_plan"] = np.where(rng.random(n) < 0.4, "yes", "no")
    data["churn"] = np.where(data["total_day_minutes"] > 60, "yes", "no")
    raw = spark.createDataFrame(pd.DataFrame(data).assign(state="X", row=range(n)))
    titled = raw.toDF(*[c.replace("_", " ").title() for c in raw.columns])
    model = early_warning.train_churn_model(early_warning.prepare_subscribers(titled), trees=5)
    got = early_warning.warn(titled, model, order_by=["row"])
    assert got.count() == n and got.orderBy("row").first()["customer_id"] == "CUST-0000"
    assert {r[0] for r in got.select("risk_tier").distinct().collect()} <= {"High", "Medium", "Low"}


def test_missing_values_and_categories_are_model_inputs(spark, separable):
    df = separable.withColumn("x1", F.when(F.col("id") % 50 != 0, F.col("x1"))).withColumn(
        "kind", F.when(F.col("id") % 40 == 0, None).when(F.col("label") == 1, "often").otherwise(F.when(F.col("id") % 3 == 0, "often").otherwise("seldom")))
    model = learning.fit_logit(df, ["x1", "x2"], categories=["kind"])
    scored = model.transform(df)
    assert scored.count() == df.count() and scored.where("probability IS NULL").count() == 0
    assert scored.columns == [*df.columns, "probability"]
    boosted = learning.positive_probability(learning.boosted_classifier(df, ["x1", "x2"], trees=3, categories=["kind"]).transform(df), "score")
    assert boosted.count() == df.count() and learning.exact_auc(boosted, "score") > 0.8


def test_registered_fits_have_the_operator_defaults(spark, small, monkeypatch):
    import inspect

    from checks import queries_models
    from checks.catalog import ENTRIES
    from ledgerlens.plans import training

    class Asked(Exception):
        pass

    def trees(df, features, specs, settings=boosting.Settings(), categories=()):
        raise Asked(settings.trees)

    def train(*args, **settings):
        given = inspect.signature(plain).bind(*args, **settings)
        given.apply_defaults()
        raise Asked(given.arguments["trees"], given.arguments["n_init"])

    plain = training.train_customer_models
    monkeypatch.setattr(boosting, "fit_many", trees)
    monkeypatch.setattr(training, "train_customer_models", train)
    monkeypatch.setattr(queries_models, "_CHURN_MODELS", {})
    for name in ("boosted_classifier", "tree_importance", "early_warning", "tweedie_regression", "cross_validate"):
        with pytest.raises(Asked) as asked:
            ENTRIES[name].run(spark, small)
        assert asked.value.args == (400,)
    monkeypatch.setattr(queries_models, "_TRAINED", {})
    with pytest.raises(Asked) as asked:
        queries_models._trained(spark, small)
    assert asked.value.args == (400, 20)
