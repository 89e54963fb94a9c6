"""Boosted trees against a plain version that looks at every cut of every node."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import boosting, explain, learning
from ledgerlens.sources import artifacts


def plain_trees(x, y, objective, trees, depth, rate, weight, base):
    """Margins and splits of boosting without sampling, by direct search over all values."""
    margin, splits = np.full(len(y), base), []
    w = np.where((y == 1) & (objective == "logistic"), weight, 1.0)
    for _ in range(trees):
        if objective == "logistic":
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - y), w * p * (1 - p)
        else:
            g = np.exp(0.5 * margin) - y * np.exp(-0.5 * margin)
            h = 0.5 * np.exp(0.5 * margin) + 0.5 * y * np.exp(-0.5 * margin)
        nodes = [(np.arange(len(y)), 0)]
        while nodes:
            rows, level = nodes.pop(0)
            value = -g[rows].sum() / (h[rows].sum() + 1) * rate
            best = (1e-9, None)
            if level < depth:
                for f in range(x.shape[1]):
                    column = x[rows, f]
                    for cut in np.unique(column[~np.isnan(column)]):
                        for missing_left in (False, True):
                            left = (column <= cut) | (np.isnan(column) & missing_left)
                            gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                            if hl < 1 or hr < 1:
                                continue
                            gain = gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
                            if gain > best[0] * (1 + 1e-9) + 1e-9:
                                best = (gain, (f, cut, missing_left, left))
            if best[1] is None:
                margin[rows] += value
            else:
                f, cut, missing_left, left = best[1]
                splits.append((f, round(float(cut), 9)))
                nodes += [(rows[left], level + 1), (rows[~left], level + 1)]
    return margin, splits


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 500
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random(n) < 0.15, 1] = np.nan
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] + np.where(np.isnan(x[:, 1]), 1.0, x[:, 1] * x[:, 2]) - 1)))).astype(int)
    spend = np.where(rng.random(n) < 0.5, 0.0, np.exp(x[:, 0]) * rng.gamma(3.0, 1.0, n))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(n), label=y, spend=spend, fold=np.arange(n) % 3)
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("objective", ["logistic", "tweedie"])
def test_trees_equal_the_plain_search(data, objective):
    pdf, df = data
    label = "label" if objective == "logistic" else "spend"
    settings = boosting.Settings(trees=6, depth=3, learning_rate=0.3, row_share=1.0, column_share=1.0)
    model = boosting.fit_many(df, ["a", "b", "c"], [boosting.Spec(label, objective, balanced=True)], settings)[0]
    y = pdf[label].to_numpy(float)
    weight = (y == 0).sum() / (y == 1).sum() if objective == "logistic" else 1.0
    margin, splits = plain_trees(pdf[["a", "b", "c"]].to_numpy(), y, objective, 6, 3, 0.3, weight, model.base)
    got = model.transform(df).toPandas().sort_values("id")
    assert got.margin.to_numpy() == pytest.approx(margin, abs=1e-7)
    used = [(int(f), round(float(model.cuts[f][c]), 9)) for t in range(6) for f, c in zip(model.forest.feature[t], model.forest.cut[t]) if f >= 0]
    assert used == splits
    assert got.prediction.to_numpy() == pytest.approx(1 / (1 + np.exp(-margin)) if objective == "logistic" else np.exp(margin))


def test_blocks_and_one_task_grow_the_same_trees(data, monkeypatch):
    _, df = data
    specs = [boosting.Spec("label", balanced=True), boosting.Spec("spend", "tweedie"), *learning.fold_specs("label", "logistic", 3)]
    settings = boosting.Settings(trees=3, depth=3, learning_rate=0.3, row_share=1.0)
    one = boosting.fit_many(df, ["a", "b", "c"], specs, settings)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 60)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    many = boosting.fit_many(df, ["a", "b", "c"], specs, settings)
    for a, b in zip(one, many):
        assert np.array_equal(a.forest.feature, b.forest.feature) and np.array_equal(a.forest.cut, b.forest.cut)
        assert a.forest.value == pytest.approx(b.forest.value, abs=1e-9)


def test_a_few_blocks_of_rows_need_no_pass_a_level(data, monkeypatch):
    _, df = data
    specs = [boosting.Spec("label", balanced=True), *learning.fold_specs("spend", "tweedie", 3)]
    settings = boosting.Settings(trees=3, depth=3, learning_rate=0.3)
    one = boosting.fit_many(df, ["a", "b", "c"], specs, settings)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    monkeypatch.delattr(boosting, "_level_pass")
    for a, b in zip(one, boosting.fit_many(df, ["a", "b", "c"], specs, settings)):
        assert np.array_equal(a.forest.feature, b.forest.feature) and np.array_equal(a.forest.value, b.forest.value)


def test_a_pass_carries_one_tree_and_blocks_suit_the_cores(data, spark, monkeypatch):
    _, df = data
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 60)
    monkeypatch.setattr(boosting, "LEAST_BLOCK_ROWS", 20)
    dealt, placed = [], []
    plain = boosting._level_pass

    def watched(held, growths, busy, cuts, tasks):
        dealt.append(held.map(lambda b: b.bins.shape[1]).collect())
        placed.extend(len(growths[i].order().forest.feature) for i in busy)
        return plain(held, growths, busy, cuts, tasks)

    monkeypatch.setattr(boosting, "_level_pass", watched)
    boosting.fit_many(df, ["a", "b", "c"], [boosting.Spec("label")], boosting.Settings(trees=3, depth=2))
    assert set(placed) == {1} and all(sum(d) == 500 and len(d) % spark.sparkContext.defaultParallelism == 0 for d in dealt)


@pytest.mark.parametrize("block_rows, sums_bytes", [(262_144, 16_000_000), (60, 16_000_000), (60, 1)])
def test_sums_of_the_heavier_child_follow_from_the_parent(data, monkeypatch, block_rows, sums_bytes):
    """In a task, in passes whose sums the driver adds, and where they meet in tasks (which forget the parent)."""
    _, df = data
    specs = [boosting.Spec("label", balanced=True), boosting.Spec("spend", "tweedie")]
    settings = boosting.Settings(trees=3, depth=3, learning_rate=0.3, row_share=1.0)  # samples go by block
    plain = boosting.fit_many(df, ["a", "b", "c"], specs, settings)
    monkeypatch.setattr(boosting, "DIFFERENCE_ROWS", 0)
    monkeypatch.setattr(boosting, "SUMS_BYTES", sums_bytes)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
    asked = []
    if block_rows == 60:  # more blocks than a task takes
        monkeypatch.setattr(boosting, "TASK_BLOCKS", 1)
        passed = boosting._level_pass

        def watched(held, growths, busy, *rest):
            asked.extend((len(growths[i].order().open), len(growths[i].open)) for i in busy if growths[i].level)
            return passed(held, growths, busy, *rest)

        monkeypatch.setattr(boosting, "_level_pass", watched)
    for a, b in zip(plain, boosting.fit_many(df, ["a", "b", "c"], specs, settings)):
        assert np.array_equal(a.forest.feature, b.forest.feature) and np.array_equal(a.forest.cut, b.forest.cut)
        assert np.array_equal(a.forest.missing_left, b.forest.missing_left)
        assert a.forest.value == pytest.approx(b.forest.value, abs=1e-9) and a.forest.cover == pytest.approx(b.forest.cover, abs=1e-9)
    assert bool(asked) == (block_rows == 60) and all(some == (every if sums_bytes == 1 else every // 2) for some, every in asked)


def test_models_that_fill_the_cores_grow_in_tasks_over_all_blocks(data, spark, monkeypatch):
    _, df = data
    specs = [boosting.Spec("spend", "tweedie"), boosting.Spec("label", balanced=True), *learning.fold_specs("label", "logistic", 3),
             *learning.fold_specs("spend", "tweedie", 3)]
    settings = boosting.Settings(trees=3, depth=3, learning_rate=0.3, row_share=1.0)  # samples go by block
    assert boosting._models_fill(500, len(specs), spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 60)
    monkeypatch.setattr(boosting, "TASK_BLOCKS", 1)
    monkeypatch.setattr(boosting, "DIFFERENCE_ROWS", 0)  # features are bundled, too
    monkeypatch.setattr(boosting, "MODEL_BLOCKS", 0)
    passes = boosting.fit_many(df, ["a", "b", "c"], specs, settings)
    monkeypatch.setattr(boosting, "MODEL_BLOCKS", 24)
    monkeypatch.delattr(boosting, "_level_pass")
    for a, b in zip(passes, boosting.fit_many(df, ["a", "b", "c"], specs, settings)):
        assert np.array_equal(a.forest.feature, b.forest.feature) and np.array_equal(a.forest.cut, b.forest.cut)
        assert a.forest.value == pytest.approx(b.forest.value, abs=1e-9)
    assert not boosting._models_fill(500, 1, 8) and not boosting._models_fill(60 * 25, 12, 12)


def test_bundled_features_have_the_sums_of_single_ones():
    rng = np.random.default_rng(2)
    n = 4000
    window = np.where(rng.random(n) < 0.1, rng.integers(1, 40, n), 0)
    bins = np.stack([rng.integers(0, 255, n), window, np.minimum(window, 7), np.where(rng.random(n) < 0.2, 255, 3), rng.integers(0, 255, n)]).astype(np.uint8)
    bundles = boosting.Bundles.of(bins)
    assert len(set(bundles.group)) < len(bins) and bundles.codes.shape == (n, len(set(bundles.group)))
    for f, (group, part) in enumerate(zip(bundles.group, bundles.parts)):
        assert np.array_equal(part[bundles.codes[:, group]], bins[f])
    growth = boosting.Growth(boosting.Spec("label"), 0, boosting.Settings(trees=1, depth=2), len(bins), 0.0, 1.0, n)
    growth.open = np.array([1, 2])
    order = growth.order()
    rows = boosting.TreeRows(bins, rng.normal(size=n), (rng.random(n) < 0.3).astype(float), np.arange(n), rng.integers(1, 4, n))
    single = rows.sums(order)
    rows.bundles = bundles
    assert rows.sums(order) == pytest.approx(single, abs=1e-9) and single.shape == (2, 2, len(order.columns), 256)


def test_codes_only_one_child_has_leave_nothing_to_the_other():
    growth = boosting.Growth(boosting.Spec("label"), 0, boosting.Settings(trees=1, depth=2, column_share=1.0), 1, 0.0, 1.0, boosting.DIFFERENCE_ROWS)
    root = np.zeros((2, 1, 1, 256))
    root[0, 0, 0, [3, 9]], root[1, 0, 0, [3, 9]] = (-0.1 - 0.2, 5.0), (0.1 + 0.2, 7.0)
    growth.take([(0, 0, 1.0, 3, False, -0.3, 0.3, 4.7, 7.3)] if growth.whole(root) is not None else [])
    light = np.zeros_like(root)
    light[0, 0, 0, 3], light[1, 0, 0, 3] = -0.3, 0.3  # 0.1 + 0.2 is a little more
    both = growth.whole(light)
    assert growth.order().open.tolist() == [1] and both.shape == (2, 2, 1, 256)
    assert both[:, 1, 0, 3].tolist() == [0, 0] and both[:, 1, 0, 9].tolist() == [5, 7]


def test_folds_learn_only_from_their_rows(data):
    pdf, df = data
    settings = boosting.Settings(trees=10, depth=3, learning_rate=0.3)
    models = boosting.fit_many(df, ["a", "b", "c"], learning.fold_specs("label", "logistic", 3), settings)
    alone = boosting.fit_many(df.where("fold <> 1"), ["a", "b", "c"], [boosting.Spec("label", balanced=True)], boosting.Settings(trees=10, depth=3, learning_rate=0.3))[0]
    assert models[1].base == pytest.approx(alone.base)
    scored = boosting.out_of_fold(df, models).toPandas().sort_values("id")
    whole = models[2].transform(df).toPandas().sort_values("id")
    own = (pdf.fold == 2).to_numpy()
    assert scored.margin[own].to_numpy() == pytest.approx(whole.margin[own].to_numpy())
    result = {r["metric"]: r for r in learning.fold_scores(df, models, lambda s: learning.classification_scores(s, "label", "prediction")).collect()}
    assert result["auc"]["folds"] == 3 and result["auc"]["mean"] > 0.65


def test_samples_do_not_depend_on_the_run():
    a, b = boosting.sampled(1, 2, 3, 10_000, 0.8), boosting.sampled(1, 2, 3, 10_000, 0.8)
    assert np.array_equal(a, b) and 0.78 < a.mean() < 0.82 and boosting.sampled(1, 3, 3, 10_000, 1.0).all()
    assert not np.array_equal(a, boosting.sampled(1, 3, 3, 10_000, 0.8))
    assert len(boosting.tree_columns(1, 1, 10, 0.8)) == 8 and len(boosting.tree_columns(1, 1, 1, 0.1)) == 1


def test_saved_model_scores_alike(spark, data, tmp_path):
    _, df = data
    df = df.withColumn("kind", F.when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 4)))
    model = learning.boosted_classifier(df, ["a", "b"], trees=4, categories=["kind"])
    artifacts.save_model(model, str(tmp_path / "model"))
    again = artifacts.load_model(str(tmp_path / "model"))
    assert model.transform(df).exceptAll(again.transform(df)).count() == 0
    assert model.transform(df).columns == [*df.columns, "margin", "prediction"]


def test_no_rows_one_class_and_missing_labels(spark):
    none = spark.createDataFrame([], "a double, label int")
    assert learning.boosted_classifier(none, ["a"], trees=2).transform(none).count() == 0
    one = spark.createDataFrame([(float(i), 1) for i in range(20)] + [(1.0, None)], "a double, label int")
    assert learning.boosted_classifier(one, ["a"], trees=2).transform(one).where("prediction < 0.9").count() == 0
    empty_column = one.withColumn("b", F.lit(None).cast("double")).withColumn("label", (F.col("a") > 9).cast("int"))
    assert learning.boosted_classifier(empty_column, ["a", "b"], trees=20).transform(empty_column).where("a > 15 AND prediction < 0.6").count() == 0


def subset_values(model, row):
    """Shapley values of one row by enumerating all subsets; unknown features follow both branches by cover."""
    from itertools import combinations
    from math import factorial

    code = boosting.codes([np.array([v], float) for v in row], model.cuts)[:, 0]
    k, f = len(row), model.forest

    def expected(known):
        def walk(t, node):
            if f.feature[t, node] < 0:
                return f.value[t, node]
            j, left, right = f.feature[t, node], 2 * node + 1, 2 * node + 2
            if j in known:
                goes = code[j] <= f.cut[t, node] or (code[j] == boosting.MISSING and f.missing_left[t, node])
                return walk(t, left if goes else right)
            return (f.cover[t, left] * walk(t, left) + f.cover[t, right] * walk(t, right)) / (f.cover[t, left] + f.cover[t, right])
        return model.base + sum(walk(t, 0) for t in range(len(f.feature)))

    out = np.zeros(k)
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        for size in range(k):
            for s in combinations(rest, size):
                out[i] += factorial(size) * factorial(k - size - 1) / factorial(k) * (expected({*s, i}) - expected(set(s)))
    return out, expected(set())


def test_contributions_equal_subset_enumeration_and_add_up(data):
    pdf, df = data
    model = boosting.fit_many(df, ["a", "b", "c"], [boosting.Spec("label", balanced=True)], boosting.Settings(trees=8, depth=4, learning_rate=0.3))[0]
    rows = explain.tree_contributions(df, model, ["id"]).toPandas()
    wide = rows.pivot(index="id", columns="feature", values="contribution").sort_index()
    margin = model.transform(df).toPandas().set_index("id").margin.sort_index()
    assert (wide.sum(axis=1) + explain.base_value(model)).to_numpy() == pytest.approx(margin.to_numpy(), abs=1e-9)
    for i in (0, 1, 2, 17, int(pdf[pdf.b.isna()].id.iloc[0])):
        want, base = subset_values(model, pdf.loc[i, ["a", "b", "c"]].to_numpy(float))
        assert wide.loc[i, ["a", "b", "c"]].to_numpy() == pytest.approx(want, abs=1e-9) and base == pytest.approx(explain.base_value(model))
    shares = {r["feature"]: r["importance"] for r in explain.tree_importance_global(df, model).collect()}
    assert shares == pytest.approx(wide.abs().mean().to_dict())
