"""k-means, mixtures and the logit against plain in-memory versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cluster, learning, lloyd, logit, mixture
from ledgerlens.sources import artifacts


def blobs(seed, centres, n, spread=0.4):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, spread, (n, len(c))) for c in centres])


@pytest.fixture(scope="module")
def points(spark):
    x = blobs(1, [(0, 0, 0), (5, 0, 0), (0, 6, 1), (6, 6, -3)], 150)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(len(x)))).repartition(5)
    return x, cluster.assemble(df, ["a", "b", "c"]).cache()


def test_boxes_assign_like_all_distances():
    x = blobs(2, [(0, 0), (4, 4), (9, 0)], 400)
    ordered, ends = lloyd.ordered(x)
    pack = lloyd.Pack.of({"pack": 0, "points": ordered.tobytes(), "leaf_ends": ends.tobytes()}, 2)
    for centres in (np.array([(0.0, 0.0), (4, 4), (9, 0)]), np.random.default_rng(0).normal(4, 3, (6, 2)), np.zeros((1, 2))):
        gap = lloyd.squared(x, centres)
        own = gap.argmin(axis=1)
        n, s, cost, compared = lloyd.assign(pack, centres)
        assert n.tolist() == np.bincount(own, minlength=len(centres)).tolist()
        assert s == pytest.approx(np.stack([x[own == j].sum(axis=0) for j in range(len(centres))]))
        assert cost.sum() == pytest.approx(gap.min(axis=1).sum())
    assert lloyd.assign(pack, np.array([(0.0, 0.0), (4, 4), (9, 0)]))[3] < len(x) / 2  # boxes inside a cluster go whole


def test_every_k_reaches_a_fixed_point_at_low_cost(points):
    x, df = points
    models = lloyd.fit_all(df, [1, 2, 4, 5], 6, 100, 3)
    for k, m in models.items():
        own = lloyd.squared(x, m.centres).argmin(axis=1)
        assert m.cost == pytest.approx(lloyd.squared(x, m.centres).min(axis=1).sum())
        assert m.centres == pytest.approx(np.stack([x[own == j].mean(axis=0) for j in range(k)]), abs=1e-5)
    truth = sum(((x[i:i + 150] - x[i:i + 150].mean(axis=0)) ** 2).sum() for i in range(0, 600, 150))
    assert models[4].cost == pytest.approx(truth) and models[5].cost < models[4].cost < models[2].cost < models[1].cost
    assert models[4].passes < 100
    labels = models[4].transform(df).toPandas().sort_values("id").cluster.to_numpy()
    assert [len(set(labels[i:i + 150])) for i in range(0, 600, 150)] == [1, 1, 1, 1]
    scan = {r["k"]: r for r in cluster.scan_table(df.sparkSession, df, {k: models[k] for k in (2, 4, 5)}).collect()}
    assert scan[4]["best"] and not scan[2]["best"]


def test_packs_and_one_task_give_the_same_fits(points, monkeypatch):
    _, df = points
    start = lloyd.fit_all(df, [3], 2, 50, 3)[3]
    monkeypatch.setattr(lloyd, "PACK_ROWS", 90)
    packed, dim = lloyd.pack(df)
    assert not lloyd.one_pack(packed)
    many = lloyd.iterate(lambda active: lloyd.lloyd_pass(packed, dim, active), {0: start.centres + 0.01}, 50)[0]
    assert many[0] == pytest.approx(start.centres, abs=1e-5) and many[1] == pytest.approx(start.cost)
    best = lloyd.fit_all(df, [4], 3, 50, 3)[4]
    assert best.cost <= lloyd.fit_all(df, [3], 3, 50, 3)[3].cost
    monkeypatch.setattr(mixture, "COARSE", 0.05)
    monkeypatch.setattr(mixture, "FINE", 0.02)
    assert mixture.fit_all(df, [2], 1, 1)[2].step < 0.02


def test_fewer_points_than_centres(spark):
    df = cluster.assemble(spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (3.0, 3.0)], ["a", "b"]), ["a", "b"])
    model = lloyd.fit_all(df, [3], 2, 20, 0)[3]
    assert model.cost == pytest.approx(0.0) and model.transform(df).select("cluster").distinct().count() == 2


def test_seeding_draws_by_squared_distance(spark):
    """Of a point far out and many near the first centre, the far one is drawn about as often as its share of d**2."""
    x = np.concatenate([np.zeros((50, 1)), np.ones((60, 1)), [[8.0]]])  # 60 x 1 against 64
    df = cluster.assemble(spark.createDataFrame(pd.DataFrame(x, columns=["a"])).coalesce(1), ["a"])
    packed, dim = lloyd.pack(df)
    drawn = lloyd.seeds(packed, dim, [2] * 400, 5)
    from_zero = [c[1, 0] for c in drawn if c[0, 0] == 0.0]
    assert len(from_zero) > 100 and 0.38 < np.mean([v == 8.0 for v in from_zero]) < 0.65


def plain_em(x, fit, steps):
    w, m, c = fit.weights.copy(), fit.means.copy(), fit.covariances.copy()
    for _ in range(steps):
        r = mixture.Mixture(w, m, c).memberships(x)[0]
        n = r.sum(axis=0)
        w, m = n / n.sum(), (r.T @ x) / n[:, None]
        c = np.stack([((x - m[j]).T * r[:, j]) @ (x - m[j]) / n[j] + mixture.FLOOR * np.eye(x.shape[1]) for j in range(len(n))])
    return mixture.Mixture(w, m, c)


def test_a_pass_is_a_step_of_expectation_maximisation(points):
    x, df = points
    packed, dim = lloyd.pack(df)
    start = mixture.Mixture(np.array([0.5, 0.3, 0.2]), x[[0, 200, 400]], np.repeat(np.eye(3)[None] * 4, 3, axis=0))
    got, want = mixture.expectation_pass(packed, dim, {7: start})[7], plain_em(x, start, 1)
    for a in ("weights", "means", "covariances"):
        assert getattr(got, a) == pytest.approx(getattr(want, a))
    assert got.mean_log_likelihood == pytest.approx(start.memberships(x)[1].mean())


def test_mixture_recovers_its_components_and_rests(points):
    x, df = points
    models = mixture.fit_all(df, [2, 4], 3, 1)
    m = models[4]
    assert sorted(m.weights) == pytest.approx([0.25] * 4, abs=0.02) and abs(m.step) < mixture.FINE
    assert plain_em(x, m, 1).memberships(x)[1].mean() - m.memberships(x)[1].mean() < 1e-6
    assert m.mean_log_likelihood == pytest.approx(m.memberships(x)[1].mean())
    table = {r["k"]: r for r in cluster.criteria_table(df.sparkSession, models).collect()}
    assert table[4]["best"] and table[4]["bic"] == pytest.approx(-2 * m.memberships(x)[1].sum() + (4 * 3 + 4 * 6 + 3) * np.log(600))
    scored = m.transform(df).toPandas().sort_values("id")
    assert np.stack(scored.membership) == pytest.approx(m.memberships(x)[0], abs=1e-9)


@pytest.fixture(scope="module")
def churners(spark):
    rng = np.random.default_rng(8)
    n = 900
    minutes, calls, state = rng.normal(180, 50, n), rng.poisson(1.5, n), rng.integers(0, 4, n)
    p = 1 / (1 + np.exp(-(0.02 * (minutes - 180) + 0.6 * calls + np.array([0.0, 0.8, -0.5, 0.3])[state] - 1.5)))
    pdf = pd.DataFrame({"id": range(n), "minutes": minutes, "charge": 0.17 * minutes, "calls": calls.astype(float), "state": [f"S{s}" for s in state],
                        "label": (rng.random(n) < p).astype(int)})
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


def plain_logit(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    return beta, np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (p * (1 - p))[:, None]))))


def test_logit_equals_newton_and_names_aliased_terms(spark, churners, tmp_path):
    pdf, df = churners
    model = learning.fit_logit(df, ["minutes", "charge", "calls"], categories=["state"])
    assert len(model.aliased) == 2 and {a for a in model.aliased if not a.startswith("state_")} < {"minutes", "charge"}
    columns = {"const": np.ones(len(pdf)), "minutes": pdf.minutes, "charge": pdf.charge, "calls": pdf.calls, **{f"state_S{i}": (pdf.state == f"S{i}") * 1.0 for i in range(4)}}
    beta, errors = plain_logit(np.stack([columns[n] for n in model.names], axis=1), pdf.label.to_numpy())
    assert model.coefs == pytest.approx(beta, rel=1e-5, abs=1e-7)
    table = {r["feature"]: r for r in learning.coefficient_table(spark, model).collect()}
    assert [table[n]["std_err"] for n in model.names] == pytest.approx(errors, rel=1e-5)
    assert all(table[n]["aliased"] and table[n]["coef"] is None for n in model.aliased) and table["calls"]["significant"]
    scored = model.transform(df).toPandas()
    assert scored.probability.mean() == pytest.approx(pdf.label.mean(), abs=1e-9)
    artifacts.save_model(model, str(tmp_path / "logit"))
    assert model.transform(df).exceptAll(artifacts.load_model(str(tmp_path / "logit")).transform(df)).count() == 0
    reduced = {r["model"]: r for r in learning.logit_reduced(df, df, ["minutes", "charge", "calls"], categories=["state"]).collect()}
    assert reduced["reduced"]["n_features"] < reduced["full"]["n_features"] == len(model.names) - 1


def test_logit_with_missing_and_new_values(spark, churners):
    _, df = churners
    holes = df.withColumns({"minutes": F.when(F.col("id") % 7 != 0, F.col("minutes")), "state": F.when(F.col("id") % 5 != 0, F.col("state"))})
    model = learning.fit_logit(holes.withColumn("label", F.when(F.col("id") % 11 != 0, F.col("label"))), ["minutes", "calls"], categories=["state"])
    odd = holes.withColumn("state", F.lit("unseen"))
    assert model.transform(odd).where("probability IS NULL").count() == 0
    assert model.rows == holes.where("id % 11 <> 0").count()
    one_class = learning.fit_logit(df.where("label = 1"), ["minutes"])
    assert one_class.transform(df).where("probability < 0.99").count() == 0


def test_rank_keeps_the_intercept_and_the_earlier_of_equal_terms():
    x = np.random.default_rng(0).normal(size=(50, 3))
    design = np.column_stack([np.ones(50), x[:, 0], x[:, 1], x[:, 0], x[:, 0] + x[:, 1], np.zeros(50)])
    kept, dependent = logit.rank_revealing(design.T @ design)
    assert 0 in kept and len(kept) == 3 and 5 in dependent and np.linalg.matrix_rank(design[:, kept]) == 3


def test_squared_distances_hold_no_array_of_all_differences():
    import tracemalloc

    x, centres = np.random.default_rng(3).normal(size=(20_000, 3)), np.random.default_rng(4).normal(size=(5, 3))
    tracemalloc.start()
    try:
        gap = lloyd.squared(x, centres)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * gap.nbytes
    assert np.array_equal(gap, ((x[:, None, :] - centres[None]) ** 2).sum(axis=2))


def test_densities_by_forward_substitution(monkeypatch):
    rng = np.random.default_rng(5)
    x, root = rng.normal(size=(300, 3)), np.tril(rng.normal(size=(2, 3, 3))) + 2 * np.eye(3)
    fit = mixture.Mixture(np.array([0.3, 0.7]), rng.normal(size=(2, 3)), root @ root.transpose(0, 2, 1))
    want = np.stack([np.log(w) - 0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) - 0.5 * np.linalg.slogdet(2 * np.pi * c)[1]
                     for w, m, c in zip(fit.weights, fit.means, fit.covariances)], axis=1)
    monkeypatch.delattr(np.linalg, "solve")  # a general solver for as many right sides as rows
    assert fit.log_joint(x) == pytest.approx(want)


def test_restarts_share_a_large_pack(points, monkeypatch):
    """More rows than a pack of the passes: enough restarts run whole in tasks, with one answer whoever runs them."""
    x, df = points
    monkeypatch.setattr(lloyd, "PACK_ROWS", 90)
    assert not lloyd.one_pack(lloyd.pack(df)[0])
    packed, dim = lloyd.pack(df, fits=40)
    assert lloyd.one_pack(packed) and packed.first()["n"] == len(x)

    def one(pack, fit):
        return [lloyd.draw(pack, np.empty((0, dim)), fit, 0)[1], [len(pack.points), fit]]

    shared, dealt = lloyd.shared_out(packed, dim, 40, one), lloyd.each_in_a_task(packed, dim, 40, one, 2)
    assert sorted(shared) == sorted(dealt) == list(range(40))
    assert all(np.array_equal(a, b) for i in dealt for a, b in zip(shared[i], dealt[i]))
    monkeypatch.delattr(lloyd, "lloyd_pass")
    for k, m in lloyd.fit_all(df, (4, 5), 20, 100, 3).items():
        own = lloyd.squared(x, m.centres).argmin(axis=1)
        assert m.cost == pytest.approx(lloyd.squared(x, m.centres).min(axis=1).sum())
        assert m.centres == pytest.approx(np.stack([x[own == j].mean(axis=0) for j in range(k)]), abs=1e-4)
    monkeypatch.setattr(lloyd, "TASK_BYTES", 1)
    assert not lloyd.one_pack(lloyd.pack(df, fits=40)[0])


def test_the_nearest_centre_is_the_first_of_equal_ones():
    x, centres = np.round(np.random.default_rng(5).normal(size=(500, 3)), 1), np.array([(0.0, 0, 0), (1, 0, 0), (0, 0, 0), (0, 1, 0)])
    gap = lloyd.squared(x, centres)
    own, best = lloyd.nearest_centre(np.ascontiguousarray(x.T), centres)
    assert np.array_equal(own, gap.argmin(axis=1)) and np.array_equal(best, gap.min(axis=1))
