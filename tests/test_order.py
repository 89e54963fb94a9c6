import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions import order


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows share one value and one group."""
    rng = np.random.default_rng(7)
    n = 9000
    same = rng.random(n) < 0.34
    pdf = pd.DataFrame({
        "k": np.arange(n), "g": np.where(same, 0, rng.integers(1, 4, n)),
        "v": np.where(same, 1.0, rng.gamma(2.0, 50.0, n)), "w": rng.integers(0, 9, n)})
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


PROBS = [0.0, 0.2, 0.33, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_quantiles_equal_linear_interpolation(hot, partitions):
    pdf, df = hot
    row = order.exact_quantiles(df.repartition(partitions), "v", PROBS).first()
    assert row["n"] == len(pdf)
    assert row["quantiles"] == pytest.approx(pdf.v.quantile(PROBS).tolist(), rel=1e-12)


def test_quantiles_do_not_depend_on_the_sketch(hot):
    pdf, df = hot
    row = order.exact_quantiles(df, "v", [0.5, 0.9], slack=0.0).first()
    assert row["quantiles"] == pytest.approx(pdf.v.quantile([0.5, 0.9]).tolist(), rel=1e-12)


def test_grouped_quantiles(hot):
    pdf, df = hot
    got = {r["g"]: r["quantiles"] for r in order.exact_quantiles(df, "v", [0.25, 0.5], by=["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part.v.quantile([0.25, 0.5]).tolist(), rel=1e-12)


def test_quantiles_skip_nulls_and_accept_one_row(spark):
    df = spark.createDataFrame([(None,), (4.0,)], "v double")
    assert order.exact_quantiles(df, "v", [0.1, 0.5]).first()["quantiles"] == [4.0, 4.0]


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_row_number_is_global(hot, partitions):
    pdf, df = hot
    got = order.global_row_number(df.repartition(partitions), ["v", "k"]).toPandas().sort_values("row_no")
    assert got.row_no.tolist() == list(range(1, len(pdf) + 1))
    assert got.k.tolist() == pdf.sort_values(["v", "k"]).k.tolist()


def test_row_number_within_groups(hot):
    pdf, df = hot
    got = order.global_row_number(df, [F.desc("v"), "k"], by=["g"]).toPandas().sort_values(["g", "row_no"])
    want = pdf.sort_values(["g", "v", "k"], ascending=[True, False, True])
    assert got.k.tolist() == want.k.tolist()
    assert got.groupby("g").row_no.max().tolist() == pdf.groupby("g").size().tolist()


def test_running_totals(hot):
    pdf, df = hot
    got = order.running_totals(df, ["v", "k"], {"upto": "w"}).toPandas().sort_values(["v", "k"])
    assert got.upto.tolist() == pdf.sort_values(["v", "k"]).w.cumsum().tolist()


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k bigint, v double")
    assert order.global_row_number(empty, ["v"]).count() == 0
    assert order.exact_quantiles(empty, "v", [0.5]).first()["quantiles"] == [None]  # one row, like any global aggregate
    assert order.exact_quantiles(empty, "v", [0.5], by=["k"]).count() == 0


@pytest.mark.parametrize("n", [1, 4, 5, 6, 203, 1499])
def test_bins_follow_interpolated_edges_and_ntile(spark, n):
    rows = spark.range(1, n + 1).select(
        F.col("id"), order.equal_count_bin(F.col("id"), F.lit(n), 5).alias("b"),
        order.ntile_bucket(F.col("id"), F.lit(n), 5).alias("t"), F.ntile(5).over(Window.orderBy("id")).alias("e"),
    ).orderBy("id").collect()
    if n > 5:
        assert [r["b"] for r in rows] == pd.qcut(np.arange(1, n + 1), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert [r["t"] for r in rows] == [r["e"] for r in rows]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-3, 3), min_size=1, max_size=40))
def test_quantiles_of_heavily_tied_values(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = order.exact_quantiles(df, "v", [0.2, 0.5, 0.8]).first()["quantiles"]
    assert got == pytest.approx(pd.Series(values, dtype=float).quantile([0.2, 0.5, 0.8]).tolist())


@pytest.mark.parametrize("bound", [12, 40, 5000])
def test_rows_at_ranks_equal_a_sort(spark, bound):
    rng = np.random.default_rng(6)
    few = [float(v) for v in rng.integers(0, 3, 900)]  # a third of the rows share each value
    wide = [None if i % 40 == 0 else float(v) for i, v in enumerate(rng.gamma(0.5, 10, 900))]
    df = spark.createDataFrame([(f"k{i:04d}", a, w) for i, (a, w) in enumerate(zip(few, wide))], "key string, few double, wide double").repartition(5)
    ranks = [1, 7, 300, 301, 512, 899, 900]
    n, got = order.rows_at_ranks(df, ["few", "wide"], "key", lambda n: ranks, bound)
    low = float("-inf")
    for name, values in (("few", few), ("wide", wide)):
        rows = sorted((low if v is None else v, f"k{i:04d}") for i, v in enumerate(values))
        assert n == 900 and got[name] == [rows[r - 1] for r in ranks]


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], "key string, a double")
    assert order.rows_at_ranks(none, ["a"], "key", lambda n: [1] if n else []) == (0, {"a": []})


def test_quintiles_need_no_sort_and_no_table(spark):
    from ledgerlens.operators import rfm

    df = spark.createDataFrame([(f"c{i}", i % 7, float(i * 37 % 101), i % 11) for i in range(103)], "customer_id string, frequency int, monetary double, recency int")
    scored = rfm.rfm_score_quintile(df)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    rows = sorted((r["frequency"], r["customer_id"], r["f_score"]) for r in scored.collect())
    assert [r[2] for r in rows] == [max(1, -(-5 * i // 102)) for i in range(103)]
