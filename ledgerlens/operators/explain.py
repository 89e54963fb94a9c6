"""Exact contributions of features to the margins of boosted trees.

A tree's Shapley values, with unknown features following both branches by cover, are sums over its leaves.
A leaf is reached under one condition a feature of its path (a range of codes, and whether missing values pass).
Let z be the cover share of a feature's branches on the path, and o be 1 if the row meets its condition, else 0.
The leaf's value v adds v * (o_i - z_i) * sum over subsets S of the other features of the path of
|S|! (m - |S| - 1)! / m! * prod(o in S) * prod(z outside S) to feature i. With m features, at most the depth, there are 2**m
patterns of o, so each leaf gets a table (pattern, feature) once, by elementary symmetric sums in m**2 steps a
pattern, and a row costs a look-up a leaf. The tables travel to the tasks; their size is bounded by trees x
leaves x 2**depth x depth numbers, about 16 MB for 400 trees of depth 5, and is checked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.boosting import MISSING, BoostedModel, codes

TABLE_BYTES = 256_000_000


@dataclass
class _Leaf:
    features: np.ndarray
    low: np.ndarray  # codes above low and up to high pass
    high: np.ndarray
    missing: np.ndarray
    table: np.ndarray  # (pattern, feature of the path)
    expected: float

    def bits(self, i: int) -> np.ndarray:
        """By code: the bit of feature ``i`` in the pattern where its condition is met, else 0."""
        code = np.arange(MISSING + 1)
        return (((code > self.low[i]) & (code <= self.high[i])) | ((code == MISSING) & self.missing[i])).astype(np.intp) << i


def _table(value: float, share: np.ndarray) -> np.ndarray:
    m = len(share)
    out = np.zeros((1 << m, m))
    for pattern in range(1 << m):
        o = np.array([pattern >> i & 1 for i in range(m)], float)
        for i in range(m):
            sums = np.array([1.0])  # by size of S: products over the other features
            for j in range(m):
                if j != i:
                    sums = np.append(sums * share[j], 0.0) + np.append(0.0, sums * o[j])
            weights = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
            out[pattern, i] = value * (o[i] - share[i]) * float(sums @ weights)
    return out


def _leaves(model: BoostedModel) -> list[_Leaf]:
    f, out = model.forest, []
    for t in range(len(f.feature)):
        paths = [(0, {})]  # feature -> (low, high, missing passes, share)
        while paths:
            node, path = paths.pop()
            j = int(f.feature[t, node])
            if j < 0:
                names = sorted(path)
                low, high, missing, share = ([path[n][i] for n in names] for i in range(4))
                value = float(f.value[t, node])
                out.append(_Leaf(np.array(names, int), np.array(low), np.array(high), np.array(missing, bool), _table(value, np.array(share)), value * float(np.prod(share))))
                continue
            low, high, missing, share = path.get(j, (-1, MISSING - 1, True, 1.0))
            cut, to_left = int(f.cut[t, node]), bool(f.missing_left[t, node])
            covers = f.cover[t, 2 * node + 1], f.cover[t, 2 * node + 2]
            for side, child in ((0, 2 * node + 1), (1, 2 * node + 2)):
                bounds = (low, min(high, cut)) if side == 0 else (max(low, cut), high)
                paths.append((child, {**path, j: (*bounds, missing and to_left == (side == 0), share * covers[side] / sum(covers))}))
    return out


def base_value(model: BoostedModel) -> float:
    """Margin of a row of which nothing is known; contributions are measured from it."""
    return model.base + sum(leaf.expected for leaf in _leaves(model))


def contribution_matrix(cuts: Sequence[np.ndarray], leaves: Sequence[_Leaf], columns: Sequence[np.ndarray]) -> np.ndarray:
    """(row, feature) contributions to the margin."""
    bins = codes(columns, cuts)
    out = np.zeros((bins.shape[0], bins.shape[1]))
    for leaf in leaves:
        pattern = np.zeros(bins.shape[1], np.intp)
        for i, j in enumerate(leaf.features):
            pattern += leaf.bits(i).take(bins[j])
        for i, j in enumerate(leaf.features):
            out[j] += leaf.table[:, i].take(pattern)
    return out.T


def _with_contributions(df: DataFrame, model: BoostedModel) -> DataFrame:
    leaves = _leaves(model)
    if (size := sum(leaf.table.nbytes for leaf in leaves)) > TABLE_BYTES:
        raise ValueError(f"{size} bytes of tables; explain fewer or shallower trees at a time")

    cuts = model.cuts

    @F.pandas_udf("array<double>")
    def parts(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(contribution_matrix(cuts, leaves, [c.to_numpy(np.float64, na_value=np.nan) for c in columns])))

    return model.inputs(df).withColumn("_parts", parts(*[F.col(f).cast("double") for f in model.features]))


def tree_contributions(df: DataFrame, model: BoostedModel, keys: Sequence[str]) -> DataFrame:
    """keys, feature, contribution and its direction, one row a feature; with ``base_value`` they add up to the margin."""
    pairs = F.explode(F.arrays_zip(F.lit(list(model.features)).alias("feature"), F.col("_parts").alias("contribution"))).alias("_p")
    rows = _with_contributions(df, model).select(*keys, pairs).select(*keys, F.col("_p.feature").alias("feature"), F.col("_p.contribution").alias("contribution"))
    return rows.withColumn("direction", F.when(F.col("contribution") > 0, "pushes toward churn").otherwise("reduces churn risk"))


def tree_importance_global(df: DataFrame, model: BoostedModel) -> DataFrame:
    """Mean absolute contribution of each feature over all rows, greatest first."""
    wide = _with_contributions(df, model).agg(*[F.avg(F.abs(F.col("_parts")[i])).alias(f) for i, f in enumerate(model.features)])
    return wide.unpivot([], list(model.features), "feature", "importance").orderBy(F.desc("importance"))
