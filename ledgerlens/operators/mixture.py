"""Gaussian mixtures with full covariances for many numbers of components and restarts at once.

One pass over the packed points is an expectation step of every fit: tasks add up, by component, the memberships
and the membership-weighted points and products, which merge by addition, and each fit's log-likelihood.
Memberships are taken by log-sum-exp, covariances have a floor on their diagonal. All restarts run until a step moves
the mean log-likelihood by less than ``COARSE``; the best restart of each K goes on to ``FINE``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.lloyd import Pack, each_in_a_task, one_pack, pack, seeds

# The covariance floor and the coarse tolerance.
FLOOR, COARSE = 1e-6, 1e-3
FINE = 1e-6


@dataclass
class Mixture:
    """Weights, means and covariances; ``mean_log_likelihood`` is that of these parameters over ``rows`` rows."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    mean_log_likelihood: float = -np.inf
    rows: int = 0
    step: float = np.inf  # by which the last step moved the mean log-likelihood

    @property
    def free_parameters(self) -> int:
        k, d = self.means.shape
        return k * d + k * d * (d + 1) // 2 + k - 1

    def log_joint(self, points: np.ndarray) -> np.ndarray:
        """(row, component) logarithm of weight times density."""
        d = points.shape[1]
        out = np.empty((len(points), len(self.weights)))
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            root = np.linalg.cholesky(c)
            z, form = [], np.zeros(len(points))
            for a in range(d):  # forward substitution, a column at a time
                rest = points[:, a] - m[a]
                for b in range(a):
                    rest -= root[a, b] * z[b]
                z.append(rest / root[a, a])
                form += z[a] ** 2
            out[:, j] = np.log(max(w, 1e-300)) - 0.5 * form - np.log(np.diag(root)).sum() - 0.5 * d * np.log(2 * np.pi)
        return out

    def memberships(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Memberships and the log-likelihood of every row."""
        joint = self.log_joint(points)
        most = joint.max(axis=1, keepdims=True)
        total = most + np.log(np.exp(joint - most).sum(axis=1, keepdims=True))
        return np.exp(joint - total), total[:, 0]

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``membership`` of every component and ``gmm_cluster``, the most likely one."""
        @F.pandas_udf("array<double>")
        def member(x: pd.Series) -> pd.Series:
            return pd.Series(list(self.memberships(np.stack(x.to_numpy()).astype(float))[0])) if len(x) else pd.Series([], dtype=object)

        placed = df.withColumn("membership", member(vector_to_array(features)))
        return placed.withColumn("gmm_cluster", (F.array_position("membership", F.array_max("membership")) - 1).cast("int"))


def _sums(fit: Mixture, points: np.ndarray) -> np.ndarray:
    """(component, sum): memberships, likelihood and rows (with the first component), weighted points and products."""
    d = points.shape[1]
    member, ll = fit.memberships(points)
    out = np.zeros((len(fit.weights), 3 + d + d * (d + 1) // 2))
    out[:, 0] = member.sum(axis=0)
    out[0, 1:3] = ll.sum(), len(points)
    out[:, 3:3 + d] = member.T @ points
    out[:, 3 + d:] = member.T @ np.stack([points[:, a] * points[:, b] for a, b in _upper(d)], axis=1)
    return out


def _upper(dim: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(dim) for b in range(a, dim)]


def _after(fit: Mixture, table: np.ndarray) -> Mixture:
    """The parameters after a step, from the sums over all rows, with the likelihood of ``fit``, the parameters before it."""
    dim = fit.means.shape[1]
    n, likelihood = table[:, 2].sum(), table[:, 1].sum()
    r = np.maximum(table[:, 0], 1e-10)
    means = table[:, 3:3 + dim] / r[:, None]
    covariances = np.empty((len(r), dim, dim))
    for c, (a, b) in enumerate(_upper(dim)):
        covariances[:, a, b] = covariances[:, b, a] = table[:, 3 + dim + c] / r - means[:, a] * means[:, b]
    covariances += FLOOR * np.eye(dim)
    return Mixture(r / r.sum(), means, covariances, likelihood / n, int(n))


def expectation_pass(packed: DataFrame, dim: int, fits: dict[int, Mixture]) -> dict[int, Mixture]:
    """The parameters after one step of each fit, with the likelihood of the parameters before it."""
    names = ["r", "ll", "n", *[f"s{a}" for a in range(dim)], *[f"p{a}_{b}" for a, b in _upper(dim)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                points = Pack.of(row, dim).points
                for i, fit in fits.items():
                    own = _sums(fit, points)
                    totals[i] = totals[i] + own if i in totals else own
        if totals:
            whole = np.concatenate(list(totals.values()))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.full(len(t), i, np.int32) for i, t in totals.items()])), pa.array(np.concatenate([np.arange(len(t), dtype=np.int32) for t in totals.values()])),
                *[pa.array(whole[:, c].copy()) for c in range(len(names))]], ["fit", "component", *names])

    schema = "fit int, component int, " + ", ".join(f"{c} double" for c in names)
    summed = packed.mapInArrow(run, schema).groupBy("fit", "component").agg(*[F.sum(c).alias(c) for c in names])
    rows: dict[int, dict[int, list[float]]] = {}
    for r in summed.collect():  # a row a component
        rows.setdefault(r["fit"], {})[r["component"]] = [r[c] for c in names]
    return {i: _after(fit, np.array([rows[i][j] for j in range(len(fit.weights))])) for i, fit in fits.items()}


def _run(advance: Callable[[dict[int, Mixture]], dict[int, Mixture]], fits: dict[int, Mixture], tolerance: float, max_iter: int) -> dict[int, Mixture]:
    """Each fit as it was when a further step moved its likelihood by less than ``tolerance``; ``advance`` is a step of all."""
    rest, active = {}, dict(fits)
    for _ in range(max_iter):
        for i, new in advance(active).items():
            before = active[i]
            moved = new.mean_log_likelihood - before.mean_log_likelihood  # ``new`` tells the likelihood of ``before``
            if moved < tolerance:
                rest[i] = Mixture(before.weights, before.means, before.covariances, new.mean_log_likelihood, new.rows, moved)
                del active[i]
            else:
                active[i] = new
        if not active:
            break
    return rest | active


def _run_in_task(packed: DataFrame, dim: int, fits: dict[int, Mixture], tolerance: float, max_iter: int) -> dict[int, Mixture]:
    """The same where all points are in one pack: a task a fit."""
    keys = list(fits)
    plain = [fits[k] for k in keys]

    def one(pack: Pack, place: int) -> list[np.ndarray]:
        m = _run(lambda active: {i: _after(f, _sums(f, pack.points)) for i, f in active.items()}, {0: plain[place]}, tolerance, max_iter)[0]
        return [m.weights, m.means.ravel(), m.covariances.ravel(), np.array([m.mean_log_likelihood, m.rows, m.step])]

    found = each_in_a_task(packed, dim, len(keys), one, 4)
    return {keys[i]: Mixture(w, m.reshape(-1, dim), c.reshape(-1, dim, dim), float(x[0]), int(x[1]), float(x[2])) for i, (w, m, c, x) in found.items()}


def fit_all(vectors: DataFrame, ks: Sequence[int], n_init: int, seed: int, max_iter: int = 500) -> dict[int, Mixture]:
    """The best of ``n_init`` restarts for each K; all fits share every pass."""
    packed, dim = pack(vectors)
    fits = [k for k in ks for _ in range(n_init)]
    spread = _covariance(packed, dim)
    start = {i: Mixture(np.full(len(c), 1 / len(c)), c, np.repeat(spread[None], len(c), axis=0)) for i, c in enumerate(seeds(packed, dim, fits, seed))}

    def run(some: dict[int, Mixture], tolerance: float, steps: int) -> dict[int, Mixture]:
        if one_pack(packed):
            return _run_in_task(packed, dim, some, tolerance, steps)
        return _run(lambda active: expectation_pass(packed, dim, active), some, tolerance, steps)

    coarse = run(start, COARSE, 100)
    best = {k: coarse[max(range(p * n_init, (p + 1) * n_init), key=lambda i: coarse[i].mean_log_likelihood)] for p, k in enumerate(ks)}
    return run({k: Mixture(m.weights, m.means, m.covariances) for k, m in best.items()}, FINE, max_iter)


def _covariance(packed: DataFrame, dim: int) -> np.ndarray:
    """Covariance of all points, from one component that holds them all."""
    one = {0: Mixture(np.ones(1), np.zeros((1, dim)), np.eye(dim)[None])}
    return expectation_pass(packed, dim, one)[0].covariances[0]
