"""k-means for many numbers of clusters and restarts at once.

The points are packed once: every task orders its rows by repeated halving along the widest side, so that
runs of up to ``LEAF`` rows fill small boxes, and stores counts, sums, squares and bounds of these boxes beside
them. One pass over the packed points serves all restarts of all K: for each it adds up members, sums and cost by
centre. A box is given to a centre whole, from its sums, when by the distance bounds of the box no other centre
can be nearer to any of its points; only the rows of the other boxes are compared with the centres.

Points that fit one pack have nothing to add up between tasks: every restart then runs where the pack is, one task
each, by the same steps and with the same result. Where there are restarts enough to keep the cores busy, a pack may have up to
``TASK_BYTES``; the tasks read it and share out the restarts: a pass costs the boxes and the rows between centres, and no job.

Seeding is k-means++ in the same way: a pass draws the next centre of every restart, each row racing with an
exponential variable of rate d**2 from its own hash, so the draw is exact, mergeable and repeatable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerlens.session import materialize

LEAF = 64
PACK_ROWS = 131_072  # of one packed record
CHUNK_ROWS = 16_384  # rows looked at together: their arrays stay in a core's cache
TASK_BYTES = 256_000_000  # of coordinates that a task holds, which runs whole restarts
TOLERANCE = 1e-10  # squared movement of all centres of a restart at which it rests
_PACKED = "pack long, n long, points binary, leaf_ends binary"


def pack(vectors: DataFrame, features: str = "features", fits: int = 0) -> tuple[DataFrame, int]:
    """(packed points, number of dimensions), written to the shared folder; rows with a missing coordinate are left out.

    ``fits`` is the number of restarts that may run in a task each: with enough of them a pack may be larger.
    """
    arrays = vectors.select(vector_to_array(features).alias("x")).where("x IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v))")
    first = arrays.first()
    dim = len(first["x"]) if first else 1
    n = arrays.count()
    parts = -(-n // PACK_ROWS) or 1
    if parts > 1 and n * dim * 8 <= TASK_BYTES and 2 * fits >= vectors.sparkSession.sparkContext.defaultParallelism:
        return _one_large_pack(arrays, dim), dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            points, ends = ordered(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(points)]), pa.array([points.tobytes()], pa.binary()),
                                               pa.array([ends.tobytes()], pa.binary())], ["pack", "n", "points", "leaf_ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.column(0).flatten().to_numpy().reshape(-1, dim))
            rows += batch.num_rows
            if rows >= PACK_ROWS * 1.5:  # one pack is kept whole when the partition is a little over
                yield packed()
                number, held, rows = number + 1, [], 0
        if held:
            yield packed()

    return materialize(arrays.repartition(parts).mapInArrow(run, _PACKED)), dim


def _one_large_pack(arrays: DataFrame, dim: int) -> DataFrame:
    """All points as one pack; they travel to its task in blocks."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).flatten().to_numpy().tobytes()], pa.binary())], ["points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(b) for batch in batches for b in batch.column(0).to_pylist()]
        if held:
            points, ends = ordered(np.concatenate(held).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([len(points)]), pa.array([points.tobytes()], pa.binary()),
                                              pa.array([ends.tobytes()], pa.binary())], ["pack", "n", "points", "leaf_ends"])

    return materialize(arrays.mapInArrow(block, "points binary").repartition(1).mapInArrow(run, _PACKED))


def ordered(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points so that runs of at most ``LEAF`` lie close together, and the ends of these runs."""
    columns, ends, waiting = np.array(points.T, order="C"), [], [(0, len(points))]
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo <= LEAF:
            ends.append(hi)
            continue
        own = columns[:, lo:hi]
        side = int(np.argmax(own.max(axis=1) - own.min(axis=1)))
        half = (hi - lo) // 2
        columns[:, lo:hi] = own[:, np.argpartition(own[side], half)]
        waiting += [(lo + half, hi), (lo, lo + half)]
    return np.ascontiguousarray(columns.T), np.array(ends, np.int64)


@dataclass
class Pack:
    number: int
    points: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(row: dict | Row, dim: int) -> Pack:
        points = np.frombuffer(row["points"]).reshape(-1, dim)
        ends = np.frombuffer(row["leaf_ends"], np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        return Pack(row["pack"], points, starts, ends - starts, np.add.reduceat(points, starts), np.add.reduceat((points ** 2).sum(axis=1), starts),
                    np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts))


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(row, centre) squared distances."""
    out = (points[:, :1] - centres[:, 0]) ** 2
    for d in range(1, points.shape[1]):  # no (row, centre, dimension) array
        out += (points[:, d:d + 1] - centres[:, d]) ** 2
    return out


def assign(pack: Pack, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(members, sums, costs) of each centre, and how many rows were compared one by one."""
    k, dim = centres.shape
    nearest, farthest = np.zeros((k, len(pack.sizes))), np.zeros((k, len(pack.sizes)))
    for low, high, at in zip(np.ascontiguousarray(pack.low.T), np.ascontiguousarray(pack.high.T), centres.T):  # a dimension at a time
        for j in range(k):
            below, above = low - at[j], at[j] - high
            nearest[j] += np.maximum(np.maximum(below, above), 0) ** 2
            farthest[j] += np.maximum(-below, -above) ** 2
    possible = nearest <= farthest.min(axis=0)
    whole = possible.sum(axis=0) == 1
    owner = possible.argmax(axis=0)[whole]
    sizes, sums, squares = pack.sizes[whole], pack.sums[whole], pack.squares[whole]
    # an empty bincount has integers
    n = np.bincount(owner, sizes, k).astype(float)
    s = np.stack([np.bincount(owner, sums[:, i], k) for i in range(dim)], axis=1).astype(float)
    c = centres[owner]
    cost = np.bincount(owner, np.maximum(squares - 2 * (c * sums).sum(axis=1) + sizes * (c ** 2).sum(axis=1), 0), k).astype(float)
    points = pack.points[np.repeat(~whole, pack.sizes)]
    for lo in range(0, len(points), CHUNK_ROWS):
        columns = np.ascontiguousarray(points[lo:lo + CHUNK_ROWS].T)
        own, gap = nearest_centre(columns, centres)
        n += np.bincount(own, minlength=k)
        s += np.stack([np.bincount(own, c, k) for c in columns], axis=1)
        cost += np.bincount(own, gap, k)
    return n, s, cost, len(points)


def nearest_centre(columns: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (the first of equal ones) of every row and its squared distance."""
    own, best = np.zeros(columns.shape[1], np.int64), None
    for j, centre in enumerate(centres):
        gap = (columns[0] - centre[0]) ** 2
        for x, c in zip(columns[1:], centre[1:]):
            gap += (x - c) ** 2
        if best is None:
            best = gap
        else:
            own[gap < best] = j
            np.minimum(best, gap, out=best)
    return own, best


def races(pack: Pack, seed: int, step: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Exponential variable of each row from ``lo``, from its place: the same in every run of a task."""
    h = np.arange(lo, len(pack.points) if hi is None else hi, dtype=np.uint64) + np.uint64((pack.number * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + step * 0x8CB92BA72F3D8DD7) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return -np.log((((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)


def draw(pack: Pack, chosen: np.ndarray, seed: int, step: int) -> tuple[float, np.ndarray]:
    """The row of a pack that wins the race for the next centre, and its time."""
    won: tuple[float, int] | None = None
    for lo in range(0, len(pack.points), CHUNK_ROWS):
        points = pack.points[lo:lo + CHUNK_ROWS]
        rate = nearest_centre(np.ascontiguousarray(points.T), chosen)[1] if step else np.ones(len(points))
        with np.errstate(divide="ignore"):
            key = races(pack, seed, step, lo, lo + len(points)) / rate
        at = int(key.argmin())
        if won is None or key[at] < won[0]:
            won = float(key[at]), lo + at
    return won[0], pack.points[won[1]]


def seeds(packed: DataFrame, dim: int, ks: Sequence[int], first_seed: int) -> list[np.ndarray]:
    """k-means++ centres of every restart (``ks`` has its K), one pass a centre for all of them."""
    chosen = [np.empty((0, dim)) for _ in ks]
    for step in range(max(ks)):
        wanting = [i for i, k in enumerate(ks) if k > step]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, list[float]]] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    pack = Pack.of(row, dim)
                    for i in wanting:
                        key, point = draw(pack, chosen[i], first_seed + i, step)
                        if i not in best or key < best[i][0]:
                            best[i] = (key, point.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()], pa.float64()),
                                              pa.array([b[1] for b in best.values()], pa.list_(pa.float64()))], ["fit", "key", "x"])

        found = packed.mapInArrow(run, "fit int, key double, x array<double>").groupBy("fit").agg(F.min_by("x", "key").alias("x"))
        for r in found.collect():  # a row a restart
            chosen[r["fit"]] = np.vstack([chosen[r["fit"]], r["x"]])
    return chosen


def lloyd_pass(packed: DataFrame, dim: int, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """(members, sums, cost) of every restart in ``centres``, from one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack.of(row, dim)
                for i, c in centres.items():
                    own = assign(pack, c)[:3]
                    totals[i] = [a + b for a, b in zip(totals[i], own)] if i in totals else list(own)
        if totals:
            fits = np.concatenate([np.full(len(t[0]), i, np.int32) for i, t in totals.items()])
            sums = np.concatenate([t[1] for t in totals.values()])
            yield pa.RecordBatch.from_arrays([
                pa.array(fits), pa.array(np.concatenate([np.arange(len(t[0]), dtype=np.int32) for t in totals.values()])),
                pa.array(np.concatenate([t[0] for t in totals.values()])), pa.array(np.concatenate([t[2] for t in totals.values()])),
                *[pa.array(sums[:, d].copy()) for d in range(dim)]], ["fit", "centre", "n", "cost", *[f"s{d}" for d in range(dim)]])

    schema = "fit int, centre int, n double, cost double, " + ", ".join(f"s{d} double" for d in range(dim))
    summed = packed.mapInArrow(run, schema).groupBy("fit", "centre").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *[f"s{d}" for d in range(dim)])])
    out = {i: [np.zeros(len(c)), np.zeros(c.shape), 0.0] for i, c in centres.items()}
    for r in summed.collect():  # a row a centre
        n, s, _ = out[r["fit"]]
        n[r["centre"]], s[r["centre"]] = r["n"], [r[f"s{d}"] for d in range(dim)]
        out[r["fit"]][2] += r["cost"]
    return {i: tuple(v) for i, v in out.items()}


@dataclass
class CentreModel:
    """Centres of a fit, its cost, and the passes it took."""

    centres: np.ndarray
    cost: float
    passes: int

    def transform(self, df: DataFrame, features: str = "features", alias: str = "cluster") -> DataFrame:
        """Add the number of the nearest centre."""
        gaps = F.transform(F.lit([[float(v) for v in c] for c in self.centres]), lambda c: F.aggregate(
            F.zip_with(c, F.col("_x"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
        placed = df.withColumn("_x", vector_to_array(features)).withColumn("_gaps", gaps)
        return placed.withColumn(alias, (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int")).drop("_x", "_gaps")


Found = tuple[np.ndarray, float, int]  # centres, cost, passes


def iterate(advance: Callable[[dict[int, np.ndarray]], dict[int, tuple[np.ndarray, np.ndarray, float]]], start: dict[int, np.ndarray], max_iter: int) -> dict[int, Found]:
    """Move all restarts until each rests; ``advance`` is one pass for those that do not."""
    now, active, cost, passes = dict(start), dict(start), {}, 0
    while active and passes < max_iter:
        passes += 1
        for i, (n, s, c) in advance(active).items():
            moved = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], active[i])  # a centre without members stays
            cost[i] = c
            if ((moved - active[i]) ** 2).sum() <= TOLERANCE:
                del active[i]
            else:
                now[i] = active[i] = moved
    if active:  # stopped by max_iter: the costs are those of the centres before
        cost.update({i: v[2] for i, v in advance(active).items()})
    return {i: (now[i], float(cost[i]), passes) for i in start}


def each_in_a_task(packed: DataFrame, dim: int, fits: int, run_one: Callable[[Pack, int], Sequence[np.ndarray]], arrays: int) -> dict[int, list[np.ndarray]]:
    """What ``run_one`` returns for the only pack and each fit: ``arrays`` arrays of doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = [np.asarray(x, np.float64).tobytes() for x in run_one(Pack.of(row, dim), row["fit"])]
                yield pa.RecordBatch.from_arrays([pa.array([row["fit"]], pa.int32()), *[pa.array([x], pa.binary()) for x in made]], ["fit", *[f"x{i}" for i in range(arrays)]])

    dealt = packed.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(fits - 1)))).repartition("fit")
    rows = dealt.mapInArrow(run, "fit int, " + ", ".join(f"x{i} binary" for i in range(arrays))).collect()  # a row a fit
    return {r["fit"]: [np.frombuffer(r[f"x{i}"]) for i in range(arrays)] for r in rows}


def shared_out(packed: DataFrame, dim: int, fits: int, run_one: Callable[[Pack, int], Sequence[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """The same where the pack is large: tasks, two a core at most, read it where it is stored and run several fits each."""
    tasks = min(fits, 2 * packed.sparkSession.sparkContext.defaultParallelism)

    def run(task: int, rows: Iterator[Row]) -> Iterator[tuple[int, list[np.ndarray]]]:
        for row in rows:
            own = Pack.of(row, dim)
            for fit in range(task, fits, tasks):
                yield fit, [np.asarray(x, np.float64).ravel() for x in run_one(own, fit)]

    read = packed.coalesce(1).rdd
    return dict(packed.sparkSession.sparkContext.union([read] * tasks).mapPartitionsWithIndex(run).collect())  # a row a fit


def _fit_in_task(packed: DataFrame, dim: int, fits: Sequence[int], seed: int, max_iter: int) -> dict[int, Found]:
    def one(pack: Pack, i: int) -> list[np.ndarray]:
        chosen = np.empty((0, dim))
        for step in range(fits[i]):
            chosen = np.vstack([chosen, draw(pack, chosen, seed + i, step)[1]])
        centres, cost, passes = iterate(lambda active: {j: (lambda n, s, c, _: (n, s, float(c.sum())))(*assign(pack, x)) for j, x in active.items()}, {i: chosen}, max_iter)[i]
        return [centres.ravel(), [cost, passes]]

    if packed.agg(F.max("n")).first()[0] <= PACK_ROWS * 1.5:
        found = each_in_a_task(packed, dim, len(fits), one, 2)
    else:
        found = shared_out(packed, dim, len(fits), one)
    return {i: (x.reshape(-1, dim), float(rest[0]), int(rest[1])) for i, (x, rest) in found.items()}


def fit_all(vectors: DataFrame, ks: Sequence[int], n_init: int, max_iter: int, seed: int) -> dict[int, CentreModel]:
    """The best of ``n_init`` restarts for each K; all restarts share every pass."""
    fits = [k for k in ks for _ in range(n_init)]
    packed, dim = pack(vectors, fits=len(fits))
    if one_pack(packed):
        found = _fit_in_task(packed, dim, fits, seed, max_iter)
    else:
        found = iterate(lambda active: lloyd_pass(packed, dim, active), dict(enumerate(seeds(packed, dim, fits, seed))), max_iter)
    out = {}
    for place, k in enumerate(ks):
        best = min(range(place * n_init, (place + 1) * n_init), key=lambda i: found[i][1])
        out[k] = CentreModel(*found[best])
    return out


def one_pack(packed: DataFrame) -> bool:
    return packed.limit(2).count() == 1
