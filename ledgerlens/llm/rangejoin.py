"""Embedding near-duplicates by an exact metric range join over pivot cells.

Vectors are scaled to length one, where cosine >= c is a Euclidean distance of at most r = sqrt(2 - 2c).

1. Equal vectors fold to one class at once, so groups of exact copies cost one row from here on.
2. ``partition`` splits every cell of more than ``rows`` members around pivots of its own, in Spark rounds,
   until all cells are small. A member's home is the cell of its nearest pivot. It is replicated as a guest to
   every other cell it can reach: not to a cell of radius R whose pivot is farther than R + r (triangle
   inequality), nor to one beyond a bisector more than r away. Of two homes under one pivot set, only the
   member of the lower cell visits the higher one, so each pair meets in one place.
3. A cell of radius R <= r/2 is *settled*: all its members link, by the triangle inequality, so their links are
   counted and not listed. So are those of any member whose distance to the pivot is at most r - R. A third of
   all rows in one group of near copies thus costs rows in proportion, not pairs.
4. ``meet`` deals every remaining cell out in units of bounded size (its members against a share of its guests)
   and compares there in double precision; a unit returns the links of each row as a count, and the few links
   that hold its rows together for the components. Links never become rows pair by pair.

Bounds are tested with a margin of ``MARGIN``, so rounding can only cost a comparison, never a link. Pivots are
drawn by hash; a poor draw costs time, not results. Where vectors have no structure at all (independent
directions in high dimensions) no metric bound excludes much, and a row visits most cells.

Vectors that are null, zero or hold null or non-finite components link with nothing; shorter vectors are filled
with zeros. Rows with a null vec_id form no links and have a null component. Rows that share a vec_id count
their links one by one and share a component. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.components import components
from ledgerlens.llm.frames import map_batches, materialize

UNIT_BYTES = 4_000_000  # of the members of a cell; its guests come in shares of twice that
FANOUT = 16
MARGIN = 1e-6
_PLACED = "cell string, home boolean, cid long, rep long, n long, u array<double>"
_SPLIT = _PLACED + ", gain long, ball string, other long"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, u): digest and components of length one; both null where a vector takes no part."""
    dim = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, units = [], []
        for x in batch.column(1).to_pylist():
            x = np.array([np.nan if c is None else c for c in x or ()], np.float64)
            most = np.abs(x).max(initial=0.0)
            if not (0 < most < np.inf):  # also not a number
                keys.append(None)
                units.append(None)
                continue
            x = np.append(x, np.zeros(dim - len(x))) + 0.0  # no negative zeros
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            x = x / most
            units.append(x / math.sqrt(float(x @ x)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))], ["vec_id", "key", "u"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(rows, run, "vec_id long, key binary, u array<double>")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim) if len(column) else np.empty((0, dim))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _chunked(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Deal the rows of every cell (with ``members`` and ``held`` rows) to chunks of bounded size."""
    chunks = F.ceil(F.col("held") / chunk_rows).cast("int")
    return rows.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("cid", F.lit(3)), chunks).cast("int")})


def _assign(rows: pa.Table, pivots: pa.Table, dim: int) -> pa.Table:
    """Distance to the nearest pivot and its number, of members."""
    pivots = pivots.sort_by("child")
    gap = _distances(_matrix(rows.column("u"), dim), _matrix(pivots.column("u"), dim))
    child = pivots.column("child").to_numpy()[gap.argmin(axis=1)] if len(gap) else np.empty(0, np.int64)
    return pa.table({**{c: rows.column(c) for c in ("cell", "home", "cid", "rep", "n", "u", "held")},
                     "child": pa.array(child.astype(np.int32)), "far": pa.array(gap.min(axis=1) if len(gap) else np.empty(0))})


def _settled(radius: np.ndarray, r: float) -> np.ndarray:
    return 2 * radius + MARGIN <= r


def _spread(rows: pa.Table, pivots: pa.Table, dim: int, r: float) -> pa.Table:
    """The rows of one chunk in the new cells, and links settled by the triangle inequality."""
    pivots = pivots.sort_by("child")
    centre, radius = _matrix(pivots.column("u"), dim), pivots.column("radius").to_numpy()
    child, total, centre_rep = (pivots.column(c).to_numpy() for c in ("child", "total", "rep"))
    settled = _settled(radius, r)
    names = np.array([f"{pivots.column('cell')[0].as_py()}.{c}{'!' if s else ''}" for c, s in zip(child, settled)], object)
    points = _matrix(rows.column("u"), dim)
    home = rows.column("home").to_numpy(zero_copy_only=False)
    n, rep = rows.column("n").to_numpy(), rows.column("rep").to_numpy()
    own = np.where(home, np.searchsorted(child, rows.column("child").to_numpy()), -1)
    gap, between = _distances(points, centre), _distances(centre, centre)
    low = gap - radius
    for m in range(len(child)):  # bisector of m and j: members of j are on j's side
        with np.errstate(divide="ignore", invalid="ignore"):
            side = (gap ** 2 - gap[:, m:m + 1] ** 2) / (2 * between[m])
        low = np.maximum(low, np.where(between[m] > MARGIN, side, -np.inf))
    later = np.arange(len(child)) > own[:, None]  # guests visit all: their own is -1
    reach = later & (low <= r + MARGIN)
    whole = reach & settled & (gap + radius + MARGIN <= r)
    visit_row, visit_to = np.nonzero(reach & ~whole)
    whole_row, whole_to = np.nonzero(whole)
    stay = np.flatnonzero(home)
    packed = stay[settled[own[stay]]] if len(stay) else stay
    take = np.concatenate([stay, visit_row, whole_row, packed])
    parts = [len(stay), len(visit_row), len(whole_row), len(packed)]
    cell = np.concatenate([names[own[stay]], names[visit_to], np.full(parts[2] + parts[3], None, object)])
    chosen = rows.take(pa.array(take))
    placed = np.arange(len(take)) < parts[0] + parts[1]
    return pa.table({
        "cell": pa.array(cell, pa.string()), "home": pa.array(np.arange(len(take)) < parts[0]), "cid": chosen.column("cid"), "rep": chosen.column("rep"),
        "n": chosen.column("n"), "u": pc.if_else(pa.array(placed), chosen.column("u"), pa.scalar(None, chosen.column("u").type)),
        "gain": pa.array(np.concatenate([np.zeros(parts[0] + parts[1], np.int64), total[whole_to], total[own[packed]] - n[packed]])),
        "ball": pa.array(np.concatenate([np.full(parts[0] + parts[1], None, object), names[whole_to], np.full(parts[3], None, object)]), pa.string()),
        "other": pa.array(np.concatenate([rep[stay], rep[visit_row], centre_rep[whole_to], centre_rep[own[packed]]])),
    })


def partition(classes: DataFrame, dim: int, r: float, rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows in their final cells, settled links); ``classes`` has cid, rep, n, u."""
    placed = materialize(classes.select(F.lit("0").alias("cell"), F.lit(True).alias("home"), "cid", "rep", "n", "u"))
    done = placed.limit(0)
    whole = placed.limit(0).select("cid", "rep", "n", F.lit(0).cast("long").alias("gain"), F.lit("").alias("ball"), F.lit(0).cast("long").alias("other"))
    chunk_rows, number = 4 * rows, 0
    while True:
        sizes = placed.groupBy("cell").agg(F.count_if("home").alias("members"), F.count("*").alias("held"))
        over = materialize(sizes.where((F.col("members") > rows) & ~F.endswith("cell", F.lit("!"))))
        if over.isEmpty():
            return done.union(placed), whole
        done = done.union(placed.join(over, "cell", "left_anti"))
        work = placed.join(over, "cell")
        place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("cid", F.lit(number)), "cid"))
        drawn = work.where("home").select("cell", "members", "held", "cid", "rep", "u").withColumn("child", place).where(F.col("child") <= FANOUT)
        drawn = materialize(drawn.where(F.col("child") <= F.lit(2) * F.ceil(F.col("members") / rows)))

        def dealt(pivots: DataFrame, *columns: str) -> DataFrame:
            """The pivots of every cell for each of its chunks."""
            chunks = F.ceil(F.col("held") / chunk_rows).cast("int")
            return pivots.select("cell", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "child", "rep", "u", *columns)

        assigned = materialize(_chunked(work, chunk_rows).groupBy("cell", "chunk").cogroup(dealt(drawn).groupBy("cell", "chunk")).applyInArrow(
            lambda left, right: _assign(left, right, dim), _PLACED + ", held long, child int, far double"))
        children = assigned.where("home").groupBy("cell", "child").agg(F.max("far").alias("radius"), F.sum("n").alias("total"))
        known = drawn.join(children, ["cell", "child"])  # a pivot without members has no cell
        split = materialize(_chunked(assigned, chunk_rows).groupBy("cell", "chunk").cogroup(dealt(known, "radius", "total").groupBy("cell", "chunk")).applyInArrow(
            lambda left, right: _spread(left, right, dim, r), _SPLIT))
        placed = split.where("cell IS NOT NULL").select(*placed.columns)
        whole = whole.union(split.where("cell IS NULL").select("cid", "rep", "n", "gain", "ball", "other"))
        number += 1


def _meet(rows: pa.Table, dim: int, least: float) -> pa.Table:
    """(cid, gain) of linked rows and (a, b) of links that hold them together, of one unit."""
    rows = rows.take(pa.array(np.argsort(~rows.column("home").to_numpy(zero_copy_only=False), kind="stable")))  # members first
    members = int(rows.column("home").to_numpy(zero_copy_only=False).sum())
    cid, rep, n = (rows.column(c).to_numpy() for c in ("cid", "rep", "n"))
    points = _matrix(rows.column("u"), dim)
    inner = rows.num_rows > 0 and rows.column("inner")[0].as_py()
    gain, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
    a, b = [], []
    for lo in range(0, len(cid), 512):
        hi = min(len(cid), lo + 512)
        close = points[lo:hi] @ points[:members].T >= least
        rows_here = np.arange(lo, hi)
        if not inner:
            close[rows_here < members] = False
        same = rows_here[rows_here < members]
        close[same - lo, same] = False
        gain[lo:hi] += close @ n[:members]
        guests = rows_here >= members
        gain[:members] += n[lo:hi][guests] @ close[guests]
        for i in np.flatnonzero(close.any(axis=1)).tolist():
            hits = np.flatnonzero(close[i])
            hits = hits[label[hits] != label[lo + i]]
            if len(hits):
                groups, first = np.unique(label[hits], return_index=True)
                a += [int(rep[lo + i])] * len(groups)
                b += rep[hits[first]].tolist()
                label[np.isin(label, groups)] = label[lo + i]
    linked = np.flatnonzero(gain)
    none = [None] * len(a)
    return pa.table({"cid": pa.array(cid[linked].tolist() + none, pa.int64()), "gain": pa.array(gain[linked].tolist() + none, pa.int64()),
                     "a": pa.array([None] * len(linked) + a, pa.int64()), "b": pa.array([None] * len(linked) + b, pa.int64())})


def meet(placed: DataFrame, dim: int, least: float, rows: int) -> DataFrame:
    """(cid, gain, a, b): what the units of all cells find."""
    settled = F.endswith("cell", F.lit("!"))
    sizes = placed.groupBy("cell").agg(F.count_if("home").alias("members"), F.count_if(~F.col("home")).alias("guests"))
    sizes = sizes.where(~settled | (F.col("guests") > 0)).select(
        "cell", F.ceil(F.col("members") / rows).cast("int").alias("lefts"), F.greatest(F.lit(1), F.ceil(F.col("guests") / (2 * rows))).cast("int").alias("rights"))
    dealt = placed.join(sizes, "cell").withColumns({
        "left": F.when(F.col("home"), F.array(F.pmod(F.xxhash64("cid", F.lit(5)), "lefts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("lefts") - 1)),
        "right": F.when(F.col("home"), F.sequence(F.lit(0), F.col("rights") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid", F.lit(5)), "rights").cast("int")))})
    units = dealt.select("cell", F.explode("left").alias("left"), "right", "home", "cid", "rep", "n", "u").withColumn("right", F.explode("right"))
    units = units.withColumn("inner", (F.col("right") == 0) & ~settled)
    return units.groupBy("cell", "left", "right").applyInArrow(lambda table: _meet(table, dim, least), "cid long, gain long, a long, b long")


def range_join(vectors: DataFrame, least: float = 0.95, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links are pairs of rows with cosine >= ``least``."""
    found = materialize(unit_vectors(vectors))
    part = found.where("key IS NOT NULL AND vec_id IS NOT NULL")
    classes = materialize(part.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("u").alias("u"))
                          .withColumn("cid", F.monotonically_increasing_id()))
    dim = max(1, classes.agg(F.coalesce(F.max(F.size("u")), F.lit(1))).first()[0])
    rows = max(2, unit_bytes // (8 * dim))
    placed, whole = partition(classes, dim, math.sqrt(2 - 2 * least), rows)
    met = materialize(meet(placed, dim, least, rows))
    # members of a settled cell also link to every row that was counted against the whole cell
    extra = whole.where("ball IS NOT NULL").groupBy("ball").agg(F.sum("n").alias("gain"))
    members = placed.where("home").join(extra, F.col("cell") == F.col("ball")).select("cid", "gain")
    gains = met.where("cid IS NOT NULL").select("cid", "gain").union(whole.select("cid", "gain")).union(members)
    counted = classes.select("key", "rep", "n", "cid").join(gains.groupBy("cid").agg(F.sum("gain").alias("gain")), "cid", "left")
    counted = counted.select("key", "rep", (F.coalesce("gain", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    # a vec_id with several vectors ties their classes
    shared = part.groupBy("vec_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("vec_id")
    tied = part.join(shared, "vec_id", "left_semi").join(classes.select("key", "rep"), "key").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    groups = components(met.where("a IS NOT NULL").select("a", "b").union(whole.select(F.col("rep").alias("a"), F.col("other").alias("b"))).union(tied))
    joined = found.join(counted, "key", "left").join(groups, F.coalesce("rep", "vec_id") == F.col("node"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    return joined.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.95
), reach(vec_id, least) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT b, least FROM reach JOIN links ON a = reach.vec_id WHERE least < b
), counted AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT r.vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(least) AS component_id, r.vec_id = min(least) AS kept
FROM reach r LEFT JOIN counted c ON r.vec_id = c.vec_id GROUP BY r.vec_id
"""
