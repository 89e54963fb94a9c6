"""Maximum likelihood over a distributed table.

Each pass evaluates the objective for a whole block of parameter vectors: tasks
add up their rows' log-likelihood for every vector and only those few sums come
back. A Newton step needs one pass for curvature and one for the step length,
so a fit costs a few dozen passes whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# rows of one batch -> (parameters -> log-likelihood of every row)
Kernel = Callable[[pd.DataFrame], Callable[[np.ndarray], np.ndarray]]


def log_gamma(z: np.ndarray) -> np.ndarray:
    """ln Gamma for positive arguments: shift above 8, then Stirling's series."""
    z = np.asarray(z, dtype=float)
    shift = np.zeros_like(z)
    x = z.copy()
    for _ in range(8):
        small = x < 8.0
        if not small.any():
            break
        shift = np.where(small, shift - np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1.0, x)
    inv = 1.0 / x
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series + shift


def mean_log_likelihood(df: DataFrame, kernel: Kernel, thetas: np.ndarray, weight: str) -> np.ndarray:
    """Weighted mean log-likelihood of each row of ``thetas`` (one Spark pass)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, total = np.zeros(len(thetas)), 0.0
        for pdf in batches:
            w = pdf[weight].to_numpy(float)
            total += w.sum()
            of_batch = kernel(pdf)
            for i, theta in enumerate(thetas):
                sums[i] += float(w @ of_batch(theta))
        yield pd.DataFrame({"candidate": np.arange(len(thetas)), "ll": sums, "w": total})

    sums = df.mapInPandas(partial, "candidate int, ll double, w double").groupBy("candidate").agg(
        F.sum("ll").alias("ll"), F.sum("w").alias("w"))
    out = np.full(len(thetas), -np.inf)
    for row in sums.collect():  # one row per candidate
        out[row["candidate"]] = row["ll"] / row["w"] if row["w"] else np.nan
    return out


def fit_positive(
    df: DataFrame, kernel: Kernel, start: np.ndarray, weight: str = "n",
    penalizer: float = 0.01, max_iter: int = 60, tolerance: float = 1e-6,
) -> np.ndarray:
    """Maximise mean log-likelihood - penalizer * sum(theta^2) over positive theta.

    Works on log theta with finite-difference Newton steps; where the curvature
    is not usable the step falls back to the gradient direction.
    """
    df = df.persist()  # read by every pass
    try:
        return _newton(df, kernel, start, weight, penalizer, max_iter, tolerance)
    finally:
        df.unpersist()


def _newton(
    df: DataFrame, kernel: Kernel, start: np.ndarray, weight: str, penalizer: float, max_iter: int, tolerance: float,
) -> np.ndarray:
    dim, h = len(start), 1e-3
    at = np.log(np.asarray(start, dtype=float))
    pairs = [(i, j) for i in range(dim) for j in range(i)]

    def objective(points: np.ndarray) -> np.ndarray:
        thetas = np.exp(points)
        value = mean_log_likelihood(df, kernel, thetas, weight) - penalizer * (thetas ** 2).sum(axis=1)
        return np.where(np.isfinite(value), value, -np.inf)

    eye = np.eye(dim) * h
    for _ in range(max_iter):
        block = [at] + [at + s * eye[i] for i in range(dim) for s in (1, -1)]
        block += [at + s * eye[i] + t * eye[j] for i, j in pairs for s in (1, -1) for t in (1, -1)]
        f = objective(np.array(block))
        if not np.isfinite(f[0]):
            raise ValueError("log-likelihood is not finite at the current parameters")
        up, down = f[1:1 + 2 * dim:2], f[2:2 + 2 * dim:2]
        gradient = (up - down) / (2 * h)
        hessian = np.diag((up - 2 * f[0] + down) / h ** 2)
        corners = f[1 + 2 * dim:].reshape(-1, 4)
        for (i, j), (pp, pm, mp, mm) in zip(pairs, corners):
            hessian[i, j] = hessian[j, i] = (pp - pm - mp + mm) / (4 * h * h)
        # ascend along every eigen-direction, whatever the sign of its curvature
        values, vectors = np.linalg.eigh(hessian)
        step = vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), 1e-4))
        longest = np.abs(step).max()
        if longest > 2.0:
            step *= 2.0 / longest
        lengths = 2.0 ** np.arange(1, -11, -1)
        tried = objective(at + lengths[:, None] * step)
        best = int(np.argmax(tried))
        if tried[best] <= f[0]:
            return np.exp(at)
        at = at + lengths[best] * step
        # judged on the objective: a parameter on the boundary keeps moving without effect
        if tried[best] - f[0] < tolerance:
            return np.exp(at)
    raise RuntimeError(f"no convergence within {max_iter} steps")
