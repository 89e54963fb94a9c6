"""Nearest-neighbour distances and the density diagnostics read from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.order import exact_quantiles, global_row_number, salted_join
from ledgerlens.session import materialize

LEAF_POINTS = 2000
ROUND_DEPTH = 8  # levels of planes a region gets in one round; bounds its sample and its row of planes
MAX_DEPTH = 62  # a region is named by its path, one bit a level
SAMPLE_PER_LEAF = 64
FILL = 0.75  # regions are cut to this share of their limit, so that an uneven sample rarely costs a round
QUERIES_PER_CHUNK = 50_000
_HALO = 11  # rows after a row that a 10-point mean and two differences look at


def _split_planes(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Median planes of a balanced binary partition of space, heap order (node i -> 2i+1, 2i+2)."""
    axis = np.zeros((1 << depth) - 1, dtype=np.int32)
    value = np.full((1 << depth) - 1, np.inf)  # an infinite plane sends everything left
    members = {0: sample}
    for node in range(len(axis)):
        rows = members.pop(node, None)
        if rows is None or len(rows) < 2:
            continue
        order = np.argsort(-(rows.max(axis=0) - rows.min(axis=0)))
        for a in order:
            cut = np.median(rows[:, a])
            left = rows[:, a] <= cut
            if left.all():  # the upper half is one tied value: cut below it
                left = rows[:, a] < cut
                if not left.any():
                    continue
                cut = rows[left, a].max()
            axis[node], value[node] = a, cut
            members[2 * node + 1], members[2 * node + 2] = rows[left], rows[~left]
            break
    return axis, value


def _beyond(columns: Sequence[str], node: Column) -> Column:
    """Signed distance of a row's point from the plane of ``node``."""
    return F.element_at(F.array(*columns), F.element_at("axis", node + 1) + 1) - F.element_at("value", node + 1)


def _first_child() -> Column:
    """What turns a last-level node of a row's planes into the name of its region."""
    width = F.pow(F.lit(2), F.col("depth")).cast("long")
    return F.col("region") * width + 1 - width


def _child(columns: Sequence[str]) -> Column:
    """Name of the region, among those its row's planes cut, that holds the point."""
    node = F.aggregate(F.sequence(F.lit(1), "depth"), F.lit(0),
                       lambda at, _: 2 * at + 1 + (_beyond(columns, at) > 0).cast("int"))
    return _first_child() + node


def _children_within(columns: Sequence[str]) -> Column:
    """Names of all regions that may hold a point closer than ``r``."""
    def down(at: Column) -> Column:
        left = F.when(_beyond(columns, at) - F.col("r") < 0, 2 * at + 1)
        right = F.when(_beyond(columns, at) + F.col("r") > 0, 2 * at + 2)
        return F.array_compact(F.array(left, right))

    nodes = F.aggregate(F.sequence(F.lit(1), "depth"), F.array(F.lit(0)), lambda at, _: F.flatten(F.transform(at, down)))
    return F.transform(nodes, lambda n: _first_child() + n)


def _regions(points: DataFrame, columns: Sequence[str], leaf_points: int) -> tuple[DataFrame, list[DataFrame]]:
    """``points`` with the ``region`` of each, none of more than ``leaf_points``, and the planes of each round.

    A round cuts every over-full region by the median planes of a sample of its own points, up to
    ``ROUND_DEPTH`` levels at once. Planes are one row a region, in a table; regions are named by their path,
    so later rounds need no knowledge of earlier ones.
    """
    placed, rounds = points.withColumn("region", F.lit(1).cast("long")), []
    while True:
        levels = F.least(F.lit(ROUND_DEPTH), F.ceil(F.log2(F.col("n") / (FILL * leaf_points)))).cast("int")
        full = materialize(placed.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > leaf_points).withColumn("depth", levels))
        if full.isEmpty():
            return placed, rounds
        if (len(rounds) + 1) * ROUND_DEPTH > MAX_DEPTH:
            raise RuntimeError(f"regions of more than {leaf_points} points after {len(rounds)} rounds of {ROUND_DEPTH} levels")
        draw = F.pmod(F.xxhash64(*columns, F.lit(len(rounds))), F.lit(1 << 40)) / float(1 << 40)  # another sample each round
        share = SAMPLE_PER_LEAF * F.pow(F.lit(2), F.col("depth")) / F.col("n")
        sample = placed.join(full, "region").where(draw < share).select("region", "depth", *columns)

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            depth = int(pdf["depth"].iloc[0])
            axis, value = _split_planes(pdf[columns].to_numpy(float), depth)
            return pd.DataFrame({"region": [pdf["region"].iloc[0]], "depth": [depth], "axis": [axis], "value": [value]})

        planes = materialize(sample.groupBy("region").applyInPandas(cut, "region bigint, depth int, axis array<int>, value array<double>"))
        rounds.append(planes)
        moved = placed.join(planes, "region", "left").withColumn("region", F.coalesce(_child(columns), "region"))
        placed = materialize(moved.drop("depth", "axis", "value"))


def _nearest(queries: np.ndarray, points: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and multiplicities of the k nearest distinct points to each query."""
    keep = min(k, len(points))
    out_d, out_w = np.empty((len(queries), keep)), np.empty((len(queries), keep), dtype=np.int64)
    rows = max(1, 4_000_000 // len(points))  # bounds the distance block, whatever the region's size
    for at in range(0, len(queries), rows):
        d2 = np.zeros((len(queries[at:at + rows]), len(points)))
        for a in range(points.shape[1]):
            d2 += (queries[at:at + rows, a][:, None] - points[None, :, a]) ** 2
        near = np.argpartition(d2, keep - 1, axis=1)[:, :keep]
        dist = np.take_along_axis(d2, near, axis=1)
        order = np.argsort(dist, axis=1)
        out_d[at:at + rows] = np.sqrt(np.take_along_axis(dist, order, axis=1))
        out_w[at:at + rows] = weight[np.take_along_axis(near, order, axis=1)]
    return out_d, out_w


def _kth(dist: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    reached = np.cumsum(weight, axis=1) >= k
    at = reached.argmax(axis=1)
    return np.where(reached.any(axis=1), dist[np.arange(len(dist)), at], np.inf)


def kth_neighbor_distance(df: DataFrame, columns: Sequence[str], key: str, k: int = 5, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Exact Euclidean distance of every row to its k-th nearest row, itself counted first.

    Equal rows are folded into one weighted point, so a value shared by a large
    part of the table costs one comparison. Space is cut into regions of at most
    ``leaf_points`` distinct points, in as many rounds as that takes. A point's k-th distance inside its region
    bounds the answer; only the few regions that reach into that radius are
    searched as well. A row with a NULL coordinate is nobody's neighbour and has no distance (NULL). Regions asked by very many points are copied to several tasks.
    """
    columns = list(columns)
    whole = materialize(df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]))
    base = whole.dropna(subset=columns)
    points = materialize(
        base.groupBy(*columns).agg(F.count("*").alias("w")).withColumn("pid", F.monotonically_increasing_id()))
    placed, rounds = _regions(points, columns, leaf_points)

    near_type = "d array<double>, dw array<bigint>"

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz, w = pdf[columns].to_numpy(float), pdf["w"].to_numpy()
        d, dw = _nearest(xyz, xyz, w, k)
        return pd.DataFrame({"pid": pdf["pid"], **{c: pdf[c] for c in columns}, "region": pdf["region"],
                             "r": _kth(d, dw, k), "d": list(d), "dw": list(dw)})

    coords = ", ".join(f"`{c}` double" for c in columns)
    first = materialize(placed.groupBy("region").applyInPandas(inside, f"pid bigint, {coords}, region bigint, r double, {near_type}"))

    asked = first.select("pid", *columns, F.col("region").alias("home"), "r", F.lit(1).cast("long").alias("region"))
    for planes in rounds:  # regions that a round did not cut pass through it
        cut = asked.join(planes, "region", "left")
        asked = cut.withColumn("region", F.explode(F.when(F.col("depth").isNull(), F.array("region")).otherwise(
            _children_within(columns)))).drop("depth", "axis", "value")
    asked = materialize(asked.where("region <> home").select("pid", *columns, "region"))
    load = materialize(asked.groupBy("region").agg(F.ceil(F.count("*") / QUERIES_PER_CHUNK).cast("int").alias("chunks")))
    queries = salted_join(asked, load, ["region"]).select("pid", *columns, "region", F.pmod(F.hash("pid"), F.col("chunks")).alias("chunk"))
    copies = placed.join(load, "region").select(
        *columns, "w", "region", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def across(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if ask.empty or have.empty:
            return pd.DataFrame({"pid": pd.Series(dtype="int64"), "d": pd.Series(dtype=object), "dw": pd.Series(dtype=object)})
        d, dw = _nearest(ask[columns].to_numpy(float), have[columns].to_numpy(float), have["w"].to_numpy(), k)
        return pd.DataFrame({"pid": ask["pid"], "d": list(d), "dw": list(dw)})

    second = queries.groupBy("region", "chunk").cogroup(copies.groupBy("region", "chunk")).applyInPandas(
        across, f"pid bigint, {near_type}")

    pairs = F.arrays_zip("d", "dw")
    candidates = first.select("pid", pairs.alias("near")).unionByName(second.select("pid", pairs.alias("near")))
    ordered = F.array_sort(F.flatten(F.collect_list("near")))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("dist"))

    def walk(acc, e):
        seen = acc["seen"] + e["dw"]
        hit = acc["dist"].isNull() & (seen >= k)
        return F.struct(seen.alias("seen"), F.when(hit, e["d"]).otherwise(acc["dist"]).alias("dist"))

    answer = candidates.groupBy("pid").agg(F.aggregate(ordered, start, walk, lambda acc: acc["dist"]).alias("kth_distance"))
    per_point = points.join(answer, "pid").select(*columns, "kth_distance")
    return whole.select(key, *columns).join(per_point, columns, "left").select(key, "kth_distance")


def density_viability(distances: DataFrame, column: str = "kth_distance", near_share: float = 0.20, flat_pct: float = 60.0) -> DataFrame:
    """Spread of neighbour distances; mostly near the minimum means no density structure."""
    q = exact_quantiles(distances, column, [0.25, 0.5, 0.75], alias="q").select("q").scalar()
    span = distances.select(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    limit = F.col("_s.lo") + near_share * (F.col("_s.hi") - F.col("_s.lo"))
    near = F.avg((F.col(column) < limit).cast("double")) * 100
    return distances.withColumn("_s", span).agg(
        F.min(column).alias("min"), F.max(column).alias("max"), near.alias("near_min_pct"), (near <= flat_pct).alias("viable"),
    ).withColumn("_q", q).select(
        "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("p75"), "max",
        (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), "near_min_pct", "viable")


def knee_detect(distances: DataFrame, column: str = "kth_distance", key: str = "customer_id", block: int = 1_000_000) -> DataFrame:
    """Position and value of the sharpest bend of the distances sorted descending.

    The bend is where the second difference of the 10-point moving mean is
    greatest (first position on ties), plus one. Positions are processed in
    blocks that each also see the first rows of the next block.
    """
    ranked = global_row_number(distances.select(key, column), [F.desc(column), key], "_no")
    rows = ranked.select((F.col("_no") - 1).alias("i"), F.col(column).alias("v"))
    home = F.floor(F.col("i") / block)
    spread = rows.withColumn("home", home).withColumn("blk", F.explode(F.when(
        (F.col("i") % block < _HALO) & (F.col("home") > 0), F.array("home", F.col("home") - 1)).otherwise(F.array("home"))))
    along = Window.partitionBy("blk").orderBy("i")
    ten = along.rowsBetween(0, 9)
    smooth = spread.withColumn("s", F.when(F.count("v").over(ten) == 10, F.avg("v").over(ten)))
    bend = smooth.withColumn("d2", F.lead("s", 2).over(along) - 2 * F.lead("s", 1).over(along) + F.col("s")).withColumn(
        "next", F.lead("v", 1).over(along)).where((F.col("home") == F.col("blk")) & F.col("d2").isNotNull())
    best = F.max_by(F.struct("i", "next"), F.struct(F.col("d2"), -F.col("i")))
    return bend.agg(best.alias("b")).select((F.col("b.i") + 1).alias("knee_index"), F.col("b.next").alias("knee_value"))
