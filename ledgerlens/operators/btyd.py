"""Probabilistic lifetime value: BG/NBD purchase process and Gamma-Gamma spend.

Formulas: Fader, Hardie and Lee (2005) and Fader and Hardie (2013). x counts
repeat purchase days, t_x is days from first to last purchase and T days from
first purchase to the snapshot. The first day is left out of the mean value m.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.likelihood import fit_positive, log_gamma
from ledgerlens.functions.scalars import as_column
from ledgerlens.operators.clean import snapshot_of
from ledgerlens.session import materialize

# Valuation settings.
STEP_DAYS = 30
HORIZON_STEP = 3  # 90 days
MONTHLY_DISCOUNT = 0.01
PROFIT_MARGIN = 0.15
PENALIZER = 0.01
CURVE_ROWS = 4_096  # rows whose curves are found together: their arrays stay in a core's cache


def btyd_summary(tx: DataFrame, snapshot: Column | None = None) -> DataFrame:
    """x, t_x, T and mean repeat-day value per customer, days collapsed first."""
    snapshot = snapshot if snapshot is not None else snapshot_of(tx)
    daily = tx.groupBy("customer_id", F.to_date("invoice_ts").alias("_day")).agg(F.sum("order_value").alias("_v"))
    first_value = F.min_by("_v", "_day")
    return daily.groupBy("customer_id").agg(
        (F.count("*") - 1).alias("x"),
        F.datediff(F.max("_day"), F.min("_day")).alias("t_x"),
        F.min("_day").alias("_first"),
        F.coalesce(F.try_divide(F.sum("_v") - first_value, F.count("*") - 1), F.lit(0.0)).alias("m"),
    ).withColumn("T", F.datediff(F.to_date(snapshot), "_first")).select("customer_id", "x", "t_x", "T", "m")


def _bgnbd_kernel(pdf: pd.DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    x, tx, T = (pdf[c].to_numpy(float) for c in ("x", "t_x", "T"))
    counts, at = np.unique(x, return_inverse=True)  # the gamma terms depend on x alone
    repeat = counts > 0

    def log_likelihood(theta: np.ndarray) -> np.ndarray:
        r, alpha, a, b = theta
        common = (log_gamma(b + counts) - log_gamma(a + b + counts) + log_gamma(r + counts)
                  - log_gamma(np.array(b)) + log_gamma(np.array(a + b)) - log_gamma(np.array(r)) + r * np.log(alpha))
        odds = np.where(repeat, np.log(a) - np.log(np.where(repeat, b + counts - 1, 1.0)), -np.inf)
        power = r + x
        return common[at] + np.logaddexp(-power * np.log(alpha + T), odds[at] - power * np.log(alpha + tx))

    return log_likelihood


def bgnbd_fit(summary: DataFrame, penalizer: float = PENALIZER) -> dict[str, float]:
    """r, alpha, a, b by penalised maximum likelihood on the histogram of (x, t_x, T).

    Time is rescaled to a unit of the mean observation so that the parameters
    stay of order one; alpha is scaled back. Equal histories are evaluated once.
    """
    histogram = summary.groupBy("x", "t_x", "T").agg(F.count("*").alias("n"))
    scale = float(summary.agg(F.avg("T")).first()[0] or 1.0)
    scaled = materialize(histogram.withColumns({"t_x": F.col("t_x") / scale, "T": F.col("T") / scale}))
    r, alpha, a, b = fit_positive(scaled, _bgnbd_kernel, np.array([1.0, 0.5, 0.5, 1.0]), penalizer=penalizer)
    return {"r": float(r), "alpha": float(alpha * scale), "a": float(a), "b": float(b)}


def _gamma_gamma_kernel(pdf: pd.DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    x, m = pdf["x"].to_numpy(float), pdf["m"].to_numpy(float)
    counts, at = np.unique(x, return_inverse=True)
    log_m, log_x = np.log(m), np.log(counts)

    def log_likelihood(theta: np.ndarray) -> np.ndarray:
        p, q, v = theta
        px = p * counts
        common = log_gamma(px + q) - log_gamma(px) - log_gamma(np.array(q)) + q * np.log(v) + px * log_x
        return common[at] + (px[at] - 1) * log_m - (px[at] + q) * np.log(v + x * m)

    return log_likelihood


def repeat_buyers(summary: DataFrame) -> DataFrame:
    return summary.where((F.col("x") > 0) & (F.col("m") > 0))


def gamma_gamma_fit(summary: DataFrame, penalizer: float = PENALIZER) -> dict[str, float]:
    """p, q, v on repeat buyers; money is rescaled by its mean during the search."""
    buyers = repeat_buyers(summary)
    scale = float(buyers.agg(F.avg("m")).first()[0] or 1.0)
    # mean values hardly ever repeat, so rows are used as they are, without a grouping shuffle
    scaled = materialize(buyers.select("x", (F.col("m") / scale).alias("m"), F.lit(1).alias("n")))
    p, q, v = fit_positive(scaled, _gamma_gamma_kernel, np.array([2.0, 2.0, 1.0]), penalizer=penalizer)
    return {"p": float(p), "q": float(q), "v": float(v * scale)}


def _lapse_odds(params: Mapping[str, float], x: Column, tx: Column, T: Column) -> Column:
    r, alpha, a, b = (float(params[k]) for k in ("r", "alpha", "a", "b"))
    ratio = F.pow((alpha + T) / (alpha + tx), r + x)
    return F.when(x > 0, a / (b + x - 1) * ratio).otherwise(0.0)


def prob_alive(params: Mapping[str, float], x: str = "x", tx: str = "t_x", T: str = "T") -> Column:
    """Probability that the customer has not dropped out; 1 without repeat purchases."""
    return 1 / (1 + _lapse_odds(params, as_column(x), as_column(tx), as_column(T)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside nested array functions."""
    return F.transform(F.array(value), body)[0]


def _series_ratios(p: float, q: float, c: Column, z: Column) -> Column:
    """Ratios (p+k)(q+k) / ((c+k)(k+1)) of successive series terms, last term first.

    They do not depend on the horizon. ``z`` is the largest argument the series
    will see; its powers fall below double precision at the last term, however many that takes.
    """
    terms = (F.ceil((38.0 + 2 * abs(p) + 2 * abs(q)) / -F.ln(z)) + 2).cast("int")
    return F.transform(F.sequence(terms, F.lit(0), F.lit(-1)), lambda k: (p + k) * (q + k) / ((c + k) * (k + 1.0)))


def purchase_curve(
    params: Mapping[str, float], days: Sequence[float], x: str = "x", tx: str = "t_x", T: str = "T",
) -> Column:
    """Expected number of purchases within each of several horizons (array of doubles).

    2F1(r+x, b+x; a+b+x-1; z) is evaluated through Euler's transformation
    (1-z)^(a-1-r-x) 2F1(a+b-1-r, a-1; a+b+x-1; z): its numerator parameters do
    not grow with the purchases, and its term ratios are shared by all horizons.
    """
    r, alpha, a, b = (float(params[k]) for k in ("r", "alpha", "a", "b"))
    if abs(a - 1) < 1e-9:
        raise ValueError("the expectation has a pole at a = 1; refit or perturb a")
    X, TX, TT = as_column(x).cast("double"), as_column(tx).cast("double"), as_column(T).cast("double")
    c, longest = a + b + X - 1, float(max(days))
    once = F.struct(
        _series_ratios(a + b - 1 - r, a - 1, c, longest / (alpha + TT + longest)).alias("ratios"),
        (c / (a - 1) / (1 + _lapse_odds(params, X, TX, TT))).alias("front"),
        (alpha + TT).alias("age"))

    def at(row: Column, t: Column) -> Column:
        z = t / (row["age"] + t)
        series = _let(z, lambda arg: F.aggregate(row["ratios"], F.lit(1.0), lambda acc, ratio: 1 + acc * ratio * arg))
        # ((alpha+T)/(alpha+T+t))^(r+x) times the factor (1-z)^(a-1-r-x) leaves (1-z)^(a-1)
        return row["front"] * (1 - F.pow(1 - z, F.lit(a - 1)) * series)

    return _let(once, lambda row: F.transform(F.array(*[F.lit(float(d)) for d in days]), lambda t: at(row, t)))


def curve_values(params: Mapping[str, float], days: Sequence[float], x: np.ndarray, tx: np.ndarray, T: np.ndarray) -> np.ndarray:
    """(row, horizon) values of ``purchase_curve``, by the same steps on whole arrays."""
    r, alpha, a, b = (float(params[k]) for k in ("r", "alpha", "a", "b"))
    p, q, longest = a + b - 1 - r, a - 1, float(max(days))
    out = np.empty((len(x), len(days)))
    terms = np.ceil((38.0 + 2 * abs(p) + 2 * abs(q)) / -np.log(longest / (alpha + T + longest))) + 2
    order = np.argsort(-terms, kind="stable")  # rows with more terms first: those that have begun lie in front
    for lo in range(0, len(x), CURVE_ROWS):
        at = order[lo:lo + CURVE_ROWS]
        X, age, own = x[at], alpha + T[at], terms[at]
        c = a + b + X - 1
        z = np.array(days, float)[:, None] / (age + np.array(days, float)[:, None])
        series = np.ones(z.shape)
        for k in range(int(own[0]) if len(own) else -1, -1, -1):
            begun = np.searchsorted(-own, -k, side="right")
            part = series[:, :begun]
            part *= (p + k) * (q + k) / ((c[:begun] + k) * (k + 1.0))
            part *= z[:, :begun]
            part += 1
        odds = np.where(X > 0, a / np.where(X > 0, b + X - 1, 1.0) * (age / (alpha + tx[at])) ** (r + X), 0.0)
        out[at] = (c / (a - 1) / (1 + odds) * (1 - (1 - z) ** (a - 1) * series)).T
    return out


def curve_of_rows(params: Mapping[str, float], days: Sequence[float], x: str = "x", tx: str = "t_x", T: str = "T") -> Column:
    """``purchase_curve`` for very many rows: arrays of a batch instead of an interpreted function a row and term. NULL in, NULL out."""
    if abs(float(params["a"]) - 1) < 1e-9:
        raise ValueError("the expectation has a pole at a = 1; refit or perturb a")

    @F.arrow_udf("array<double>")
    def curve(x: pa.Array, tx: pa.Array, T: pa.Array) -> pa.Array:
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in (x, tx, T)])
        values = np.zeros((len(known), len(days)))
        values[known] = curve_values(params, days, *[c.to_numpy(zero_copy_only=False)[known].astype(float) for c in (x, tx, T)])
        ends = pa.array(np.arange(len(known) + 1, dtype=np.int32) * len(days))
        return pa.ListArray.from_arrays(ends, pa.array(values.ravel()), mask=pa.array(~known))

    return curve(*[as_column(c).cast("double") for c in (x, tx, T)])


def expected_purchases(params: Mapping[str, float], days: float, x: str = "x", tx: str = "t_x", T: str = "T") -> Column:
    """Expected number of purchases in the next ``days`` days."""
    return purchase_curve(params, [days], x, tx, T)[0]


def expected_spend(params: Mapping[str, float], x: str = "x", m: str = "m") -> Column:
    """Expected value per purchase: the population mean shrunk towards the customer's own."""
    p, q, v = (float(params[k]) for k in ("p", "q", "v"))
    X, M = as_column(x), as_column(m)
    return p * (v + X * M) / (p * X + q - 1)


def monthly_curve(params: Mapping[str, float], months: int = 12) -> Column:
    return purchase_curve(params, [STEP_DAYS * j for j in range(1, months + 1)])


def discounted_value(curve: Column, gamma: Mapping[str, float], months: int) -> Column:
    """Expected spend over the first ``months`` steps of a monthly curve, each discounted to today."""
    steps = F.arrays_zip(
        F.slice(curve, 1, months).alias("e"), F.concat(F.array(F.lit(0.0)), F.slice(curve, 1, months - 1)).alias("before"),
        F.array(*[F.lit((1 + MONTHLY_DISCOUNT) ** -j) for j in range(1, months + 1)]).alias("factor"))
    gains = F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + (s["e"] - s["before"]) * s["factor"])
    return expected_spend(gamma) * gains


def score_purchases(summary: DataFrame, bgnbd: Mapping[str, float], days: int = 90) -> DataFrame:
    """Expected purchases and P(alive) for every customer."""
    return summary.withColumns({
        f"predicted_purchases_{days}d": expected_purchases(bgnbd, days), "prob_alive": prob_alive(bgnbd)})


def clv_discounted(summary: DataFrame, bgnbd: Mapping[str, float], gamma: Mapping[str, float]) -> DataFrame:
    """90-day and 12-month value of repeat buyers, gross and at the profit margin."""
    valued = repeat_buyers(summary).withColumn("_curve", monthly_curve(bgnbd)).withColumns({
        "clv_90d": discounted_value(F.col("_curve"), gamma, 3), "clv_12m": discounted_value(F.col("_curve"), gamma, 12)})
    return valued.withColumns({
        "clv_90d_profit": F.col("clv_90d") * PROFIT_MARGIN, "clv_12m_profit": F.col("clv_12m") * PROFIT_MARGIN}).drop("_curve")


def probabilistic_scores(summary: DataFrame, bgnbd: Mapping[str, float], gamma: Mapping[str, float]) -> DataFrame:
    """All probabilistic columns of the customer table; value and P(alive) only for repeat buyers."""
    eligible = (F.col("x") > 0) & (F.col("m") > 0)

    def valued(c: Column) -> Column:
        return F.when(eligible, c)

    return summary.withColumn("_curve", curve_of_rows(bgnbd, [STEP_DAYS * j for j in range(1, 13)])).select(
        "customer_id",
        F.col("_curve")[HORIZON_STEP - 1].alias("predicted_purchases_90d"),
        valued(prob_alive(bgnbd)).alias("prob_alive"),
        valued(discounted_value(F.col("_curve"), gamma, HORIZON_STEP)).alias("clv_90d"),
        valued(discounted_value(F.col("_curve"), gamma, 12)).alias("clv_12m"),
    ).withColumn("clv_12m_profit", F.col("clv_12m") * PROFIT_MARGIN)
