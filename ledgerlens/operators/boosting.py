"""Second-order boosted trees on histograms; many models grow in one scan.

Bins come from quantile sketches, once for all models of a scan. The binned rows are stored in blocks, a
byte a feature, with their labels and a bit for each model that learns from them: folds of a
cross-validation and the final fit are models of the same scan and share bins, rows and passes.

A pass over the blocks adds up the gradients and curvatures of every open node of every model by feature and
bin. Where the sums of all tasks are few (``SUMS_BYTES``, whatever the number of rows) the driver adds them up; else
they meet by (model, feature), where the best split of each node is chosen, and only those splits come back. From
``DIFFERENCE_ROWS`` rows on only the lighter child of a split is added up: its sibling's sums are those of the parent
without it. A pass grows one level of one tree of all models. The blocks stay persisted with the
margins after the last finished tree, so a pass places rows in the tree at hand alone; every ``REFRESH``
trees they are written, which bounds what a lost executor costs. There are as many blocks as the cluster has cores, or a multiple.
Up to ``TASK_BLOCKS`` blocks of rows (about 30 MB, less than a usual partition) cost less to grow where they are than
a pass a level costs to start: they make one block, and every model grows in a task of its own, by the same steps. Both ways give the same trees, but for the order of sums of doubles.
Where there are models enough to keep the cores busy, each also grows in a task of its own on up to ``MODEL_BLOCKS`` blocks, which the task
reads and holds (about 600 MB with all that it works on): a row's place, derivatives and margin then stay where they are from level to level. Such a task adds up
features whose codes go together (windows of one measure, counts of the same lines) as one, by their joint codes, and parts the sums afterwards.

Missing values have a bin of their own and go to the side that gains more. Rows without label are not learnt
from. A model without rows, or with one class only, keeps its base value.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import materialize

# Ensemble settings.
TREES, DEPTH, LEARNING_RATE, ROW_SHARE, COLUMN_SHARE, TWEEDIE_POWER = 400, 5, 0.05, 0.8, 0.8, 1.5
L2, LEAST_CURVATURE = 1.0, 1.0

CUTS = 254  # of a feature; codes 0..254, 255 for a missing value
MISSING = 255
BLOCK_ROWS = 262_144
TASK_BLOCKS = 4
MODEL_BLOCKS = 24  # of a task that holds all rows of a model
BUNDLE_CELLS = 2048  # joint codes of features added up together: their sums stay in a core's cache
LEAST_BLOCK_ROWS = 16_384  # more cores than such blocks are not used
REFRESH = 50
SUMS_BYTES = 16_000_000  # of all tasks that one task, or the driver, adds up
DIFFERENCE_ROWS = 65_536  # fewer rows are added up node by node, which costs little
CHUNK_ROWS = 32_768  # rows looked at together: their arrays stay in a core's cache
MAX_MODELS = 62  # one bit each in a long
_BLOCKS = "block long, n long, bins binary, labels binary, member binary"


@dataclass(frozen=True)
class Spec:
    """One model: its label, the rows it learns from, and how."""

    label: str
    objective: str = "logistic"  # or "tweedie": log link, of ``TWEEDIE_POWER``
    where: Column | None = None
    balanced: bool = False  # positives weigh negatives per positive
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    trees: int = TREES
    depth: int = DEPTH
    learning_rate: float = LEARNING_RATE
    row_share: float = ROW_SHARE
    column_share: float = COLUMN_SHARE

    @property
    def nodes(self) -> int:
        """Places of a tree as a heap: the children of i are 2i + 1 and 2i + 2."""
        return 2 ** (self.depth + 1) - 1


@dataclass
class Forest:
    """Trees as arrays (tree, node): feature -1 marks a leaf; codes up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(trees: int, nodes: int) -> Forest:
        shape = (trees, nodes)
        return Forest(np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape, bool), *(np.zeros(shape) for _ in range(3)))

    def part(self, lo: int, hi: int) -> Forest:
        return Forest(*(getattr(self, c)[lo:hi] for c in _ARRAYS))

    def steps(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature asked by every node, and the next node by (node, code); a leaf leads to itself."""
        feature, node = self.feature[tree].astype(np.int64), np.arange(self.feature.shape[1])[:, None]
        code = np.arange(256)
        left = (code <= self.cut[tree][:, None]) | ((code == MISSING) & self.missing_left[tree][:, None])
        return np.maximum(feature, 0), np.where(feature[:, None] >= 0, 2 * node + 2 - left, node).ravel()

    def place(self, bins: np.ndarray, tree: int, levels: int, start: np.ndarray | None = None, rows: np.ndarray | None = None) -> np.ndarray:
        """Node of every row (or of ``rows``) after so many levels from ``start`` (the root); rows stay where a leaf is."""
        feature, following = self.steps(tree)
        width, flat = len(bins), bins.T.reshape(-1)  # a row's codes lie together
        rows = np.arange(bins.shape[1]) if rows is None else rows
        node = np.zeros(len(rows), np.int64) if start is None else start.copy()
        for lo in range(0, len(rows), CHUNK_ROWS):
            own, at = node[lo:lo + CHUNK_ROWS], rows[lo:lo + CHUNK_ROWS] * width
            for _ in range(levels):
                own = following.take(own * 256 + flat.take(feature.take(own) + at))
            node[lo:lo + CHUNK_ROWS] = own
        return node

    def margin(self, bins: np.ndarray) -> np.ndarray:
        """Sum of all trees for every row."""
        out, bins = np.zeros(bins.shape[1]), np.asfortranarray(bins)
        depth = (self.feature.shape[1] + 1).bit_length() - 2
        for t in range(len(self.feature)):
            out += self.value[t][self.place(bins, t, depth)]
        return out


_ARRAYS = ("feature", "cut", "missing_left", "value", "cover", "gain")


def gradients(objective: str, margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the margin."""
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return weight * (p - y), weight * np.maximum(p * (1 - p), 1e-16)
    a, b = np.exp((1 - TWEEDIE_POWER) * margin), np.exp((2 - TWEEDIE_POWER) * margin)
    return weight * (b - y * a), weight * ((2 - TWEEDIE_POWER) * b + (TWEEDIE_POWER - 1) * y * a)


def sampled(seed: int, tree: int, block: int, n: int, share: float) -> np.ndarray:
    """Rows of a block that a tree learns from, by hash: the same wherever and however often it is asked."""
    h = np.arange(n, dtype=np.uint64) + np.uint64((block * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + tree * 0x8CB92BA72F3D8DD7) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) < np.uint64(min(2**64 - 1, int(share * 2**64)))


def tree_columns(seed: int, tree: int, features: int, share: float) -> np.ndarray:
    """Features a tree may split on."""
    return np.sort(np.random.default_rng((seed, tree)).permutation(features)[:max(1, round(share * features))])


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Best cut of every histogram (..., code): gain, cut, missing_left, g_left, h_left, g, h; gain 0 without one."""
    g, h = sums[0], sums[1]
    missing_g, missing_h = g[..., MISSING, None], h[..., MISSING, None]
    all_g, all_h = g.sum(axis=-1, keepdims=True), h.sum(axis=-1, keepdims=True)
    left_g, left_h = np.cumsum(g[..., :MISSING], axis=-1), np.cumsum(h[..., :MISSING], axis=-1)
    best = None
    for to_left in (False, True) if missing_h.any() else (False,):
        gl, hl = (left_g + missing_g, left_h + missing_h) if to_left else (left_g, left_h)
        gr, hr = all_g - gl, all_h - hl
        gain = gl ** 2 / (hl + L2) + gr ** 2 / (hr + L2) - all_g ** 2 / (all_h + L2)
        gain = np.where((hl >= LEAST_CURVATURE) & (hr >= LEAST_CURVATURE), gain, 0.0)
        cut = gain.argmax(axis=-1)
        found = [np.take_along_axis(x, cut[..., None], -1)[..., 0] for x in (gain, gl, hl)]
        if best is None:
            best = [found[0], cut, np.zeros(cut.shape, bool), found[1], found[2]]
        else:  # a tie sends missing values right
            more = found[0] > best[0] * (1 + 1e-12) + 1e-12
            best = [np.where(more, new, old) for new, old in zip((found[0], cut, True, found[1], found[2]), best)]
    return (*best, all_g[..., 0], all_h[..., 0])


class Growth:
    """One model while it grows: its forest so far and the open nodes of the tree at hand."""

    def __init__(self, spec: Spec, slot: int, settings: Settings, features: int, base: float, weight: float, rows: float):
        self.objective, self.seed, self.slot, self.base, self.weight = spec.objective, spec.seed, slot, base, weight  # slot: of its label
        self.settings, self.features = settings, features
        self.forest = Forest.empty(settings.trees, settings.nodes)
        self.tree, self.level, self.open = 0, 0, np.array([0])
        self.differs = rows >= DIFFERENCE_ROWS
        self.known: tuple[np.ndarray, np.ndarray] | None = None  # nodes of the level before, and their sums

    def columns(self) -> np.ndarray:
        return tree_columns(self.seed, self.tree, self.features, self.settings.column_share)

    def order(self) -> Order:
        return Order(self.objective, self.seed, self.slot, self.weight, self.settings.row_share, self.tree, self.level, self.added(), self.columns(),
                     self.forest.part(self.tree, self.tree + 1))

    def added(self) -> np.ndarray:
        """The open nodes to add up: of two siblings the lighter, where the sums of their parent are known."""
        if self.known is None:
            return self.open
        left, cover = self.open[::2], self.forest.cover[self.tree]  # children are opened in pairs
        return np.where(cover[left] <= cover[left + 1], left, left + 1)

    def whole(self, sums: np.ndarray) -> np.ndarray:
        """Sums of all open nodes from those of ``added``."""
        if self.known is not None:
            added, (nodes, before) = self.added(), self.known
            parent = before[:, np.searchsorted(nodes, (added - 1) // 2)]
            rest = parent - sums
            # codes that only the other child has leave what rounding leaves
            rest[:, (rest[1] <= 1e-11 * parent[1]) & (np.abs(rest[0]) <= 1e-9 * (np.abs(parent[0]) + parent[1]))] = 0
            right = (added % 2 == 0)[None, :, None, None]
            sums = np.stack([np.where(right, rest, sums), np.where(right, sums, rest)], axis=2).reshape(2, len(self.open), *sums.shape[2:])
        self.known = (self.open, sums) if self.differs else None
        return sums

    def take(self, splits: Sequence[tuple]) -> None:
        """Split the open nodes by (node, feature, gain, cut, missing_left, g_left, h_left, g, h) and go one level down."""
        f, t, s = self.forest, self.tree, self.settings
        opened = []
        for node, feature, gain, cut, missing_left, gl, hl, g, h in sorted(splits):
            f.cover[t, node] = h
            if self.level == 0:
                f.value[t, node] = -g / (h + L2) * s.learning_rate
            if gain <= 1e-9:
                continue
            f.feature[t, node], f.cut[t, node], f.missing_left[t, node], f.gain[t, node] = feature, cut, missing_left, gain
            for child, (cg, ch) in zip((2 * node + 1, 2 * node + 2), ((gl, hl), (g - gl, h - hl))):
                f.value[t, child], f.cover[t, child] = -cg / (ch + L2) * s.learning_rate, ch
                opened.append(child)
        self.level += 1
        if self.level == s.depth or not opened:
            self.tree, self.level, opened, self.known = self.tree + 1, 0, [0], None
        self.open = np.array(opened)

    @property
    def done(self) -> bool:
        return self.tree == self.settings.trees


@dataclass
class Order:
    """What a task needs to know of a model to add up a level of its tree."""

    objective: str
    seed: int
    slot: int
    weight: float
    row_share: float
    tree: int
    level: int
    open: np.ndarray
    columns: np.ndarray
    forest: Forest  # the tree at hand alone

    def rows(self, bins: np.ndarray, margin: np.ndarray, y: np.ndarray, learnt: np.ndarray, *blocks: tuple[int, int]) -> TreeRows:
        """The rows of blocks (number, rows) that the tree learns from, of ``learnt``, placed down to the level at hand."""
        picked = np.concatenate([sampled(self.seed, self.tree, number, n, self.row_share) for number, n in blocks])
        rows = np.flatnonzero(picked & learnt)
        return TreeRows(bins, margin, y, rows, self.forest.place(bins, 0, self.level, rows=rows))

    def derivatives(self, margin: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradients and curvatures as complex numbers: one addition serves both."""
        out = np.empty(len(y), complex)
        weight = np.where(y == 1, self.weight, 1.0) if self.objective == "logistic" else np.ones(len(y))
        out.real, out.imag = gradients(self.objective, margin, y, weight)
        return out


@dataclass
class Bundles:
    """Features in groups whose joint codes are few: one addition a row serves a group."""

    group: np.ndarray  # of each feature
    codes: np.ndarray  # (row, group) joint codes
    parts: list[np.ndarray]  # of each feature: its code by joint code

    @staticmethod
    def of(bins: np.ndarray) -> Bundles:
        """Features with few codes first, each joins the group with which it has the fewest joint codes, if few enough."""
        joint: list[np.ndarray] = []
        cells: list[dict[int, np.ndarray]] = []  # code of each member by joint code
        for f in np.argsort([len(np.unique(b)) for b in bins], kind="stable"):
            best, own = None, bins[f]
            for i, j in enumerate(joint):
                occupied = np.flatnonzero(np.bincount(j.astype(np.int64) * 256 + own, minlength=1))
                if len(occupied) <= BUNDLE_CELLS and (best is None or len(occupied) < len(best[1])):
                    best = i, occupied
            if best is None:
                joint.append(own.astype(np.uint16))
                cells.append({int(f): np.arange(256)})
                continue
            i, occupied = best
            place = np.zeros(occupied[-1] + 1, np.uint16)
            place[occupied] = np.arange(len(occupied))
            joint[i] = place.take(joint[i].astype(np.int64) * 256 + own)
            cells[i] = {**{m: c[occupied // 256] for m, c in cells[i].items()}, int(f): occupied % 256}
        group, parts = np.zeros(len(bins), np.int64), [np.empty(0)] * len(bins)
        for i, members in enumerate(cells):
            for f, c in members.items():
                group[f], parts[f] = i, c
        return Bundles(group, np.stack(joint, axis=1), parts)


@dataclass
class TreeRows:
    """Rows that a tree learns from, and the node each has come to."""

    bins: np.ndarray
    margin: np.ndarray
    y: np.ndarray
    rows: np.ndarray
    node: np.ndarray
    both: np.ndarray | None = None  # derivatives, where they are kept from level to level
    bundles: Bundles | None = None

    def keep(self, order: Order) -> None:
        """Find the derivatives once for all levels."""
        self.both = np.empty(len(self.rows), complex)
        for lo in range(0, len(self.rows), CHUNK_ROWS):
            at = self.rows[lo:lo + CHUNK_ROWS]
            self.both[lo:lo + CHUNK_ROWS] = order.derivatives(self.margin[at], self.y[at])

    def sums(self, order: Order) -> np.ndarray:
        """(2, node, column, code) sums of gradients and curvatures over the open nodes, added in the order of the rows."""
        slot, nodes = np.full(order.forest.feature.shape[1], -1), len(order.open)
        slot[order.open] = np.arange(nodes)
        if self.bundles is None:
            by_row, taken, sizes = self.bins.T, order.columns, [256] * len(order.columns)
        else:
            by_row, taken = self.bundles.codes, np.unique(self.bundles.group[order.columns])
            sizes = [len(self.bundles.parts[np.flatnonzero(self.bundles.group == i)[0]]) for i in taken]
        out = [np.zeros(nodes * n, complex) for n in sizes]
        for lo in range(0, len(self.rows), CHUNK_ROWS):
            at, place = self.rows[lo:lo + CHUNK_ROWS], slot.take(self.node[lo:lo + CHUNK_ROWS])
            both = None if self.both is None else self.both[lo:lo + CHUNK_ROWS]
            inside = np.flatnonzero(place >= 0)
            if len(inside) < len(at):
                at, place, both = at.take(inside), place.take(inside), None if both is None else both.take(inside)
            both = order.derivatives(self.margin.take(at), self.y.take(at)) if both is None else both
            own = by_row.take(at, axis=0)
            for i, (f, n) in enumerate(zip(taken, sizes)):
                np.add.at(out[i], place * n + own[:, f], both)
        if self.bundles is not None:
            out = [self._part(out[np.searchsorted(taken, self.bundles.group[f])], self.bundles.parts[f], nodes) for f in order.columns]
        out = np.stack(out).reshape(len(order.columns), nodes, 256).swapaxes(0, 1)
        return np.stack([out.real, out.imag])

    @staticmethod
    def _part(sums: np.ndarray, code: np.ndarray, nodes: int) -> np.ndarray:
        """Sums of one feature from those of its group."""
        out = np.zeros(nodes * 256, complex)
        np.add.at(out, (np.arange(nodes)[:, None] * 256 + code).ravel(), sums)
        return out

    def step(self, forest: Forest, levels: int = 1) -> None:
        """So many levels down."""
        self.node = forest.place(self.bins, 0, levels, self.node, self.rows)


def _chosen(growth: Growth, sums: np.ndarray) -> list[tuple]:
    """The best split of every open node over its columns."""
    return _picked(growth.open, growth.columns(), best_splits(growth.whole(sums)))


def _picked(open_nodes: np.ndarray, columns: np.ndarray, found: Sequence[np.ndarray]) -> list[tuple]:
    """The column of the highest gain of every open node, the first of equal ones; ``found`` is by (node, column)."""
    gain, cut, missing_left, gl, hl, g, h = found
    best = gain.argmax(axis=1)
    return [(int(node), int(columns[c]), float(gain[i, c]), int(cut[i, c]), bool(missing_left[i, c]), float(gl[i, c]), float(hl[i, c]), float(g[i, c]), float(h[i, c]))
            for i, (node, c) in enumerate(zip(open_nodes, best))]


# ---- binned blocks

def feature_cuts(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Ascending cut values of each feature, from one pass of quantile sketches over all of them."""
    probs = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), probs, 20_000).alias(f"q{i}")
                   for i, f in enumerate(features)]).first()
    return [np.unique(np.array(row[i] if row[i] is not None else [], np.float64)) for i in range(len(features))]


def codes(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(feature, row) codes: the number of cuts below the value; ``MISSING`` for none."""
    out = np.empty((len(cuts), len(columns[0]) if columns else 0), np.uint8)
    for i, (x, c) in enumerate(zip(columns, cuts)):
        out[i] = np.where(np.isnan(x), MISSING, np.searchsorted(c, x, side="left"))
    return out


def _doubles(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def binned_blocks(df: DataFrame, features: Sequence[str], labels: Sequence[str], specs: Sequence[Spec], cuts: Sequence[np.ndarray]) -> DataFrame:
    """Rows in blocks of about ``BLOCK_ROWS``, written to the shared folder."""
    member = sum((F.when((F.col(s.label).isNotNull() & (F.lit(True) if s.where is None else F.coalesce(s.where, F.lit(False)))), F.lit(1 << i)).otherwise(0).cast("long")
                  for i, s in enumerate(specs)), F.lit(0).cast("long"))
    narrow = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)],
                       *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"y{i}") for i, c in enumerate(labels)], member.alias("member"))
    narrow = narrow.where("member <> 0")
    n, cores = narrow.count(), df.sparkSession.sparkContext.defaultParallelism
    if n <= TASK_BLOCKS * BLOCK_ROWS:
        parts, most = 1, TASK_BLOCKS * BLOCK_ROWS
    else:  # blocks are added up apart: all cores get as many
        parts, most = -(-n // BLOCK_ROWS), BLOCK_ROWS * 1.5
        parts = max(parts, min(-(-parts // cores) * cores, -(-n // LEAST_BLOCK_ROWS)))
    width = len(features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []
        rows = 0

        def block() -> pa.RecordBatch:
            bins, y, m = (np.concatenate([h[i] for h in held], axis=-1) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([bins.shape[1]]), *[pa.array([x.tobytes()], pa.binary()) for x in (bins.T, y, m)]],
                                              ["block", "n", "bins", "labels", "member"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [_doubles(c) for c in batch.columns[:-1]]
            held.append((codes(columns[:width], cuts), np.stack(columns[width:]), batch.columns[-1].to_numpy()))
            rows += batch.num_rows
            if rows >= most and parts > 1:  # one block is kept whole when the partition is a little over
                yield block()
                number, held, rows = number + 1, [], 0
        if held:
            yield block()

    return materialize(narrow.repartition(parts).mapInArrow(pack, _BLOCKS))


@dataclass
class _Block:
    number: int
    bins: np.ndarray  # (feature, row), stored row by row
    labels: np.ndarray
    member: np.ndarray
    margins: np.ndarray | None = None  # (model, row)

    @staticmethod
    def of(row: dict | Row, features: int) -> _Block:
        n = row["n"]
        return _Block(row["block"], np.frombuffer(row["bins"], np.uint8).reshape(n, features).T, np.frombuffer(row["labels"]).reshape(-1, n),
                      np.frombuffer(row["member"], np.int64))

    def learns(self, model: int) -> np.ndarray:
        return (self.member >> model & 1).astype(bool)


def _starts(blocks: DataFrame, specs: Sequence[Spec], labels: Sequence[str], features: int) -> list[tuple[float, float, float]]:
    """Base margin, weight of positives and number of rows of each model, from one pass."""
    slots = [labels.index(s.label) for s in specs]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(slots), 2))
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block.of(row, features)
                for i, slot in enumerate(slots):
                    y = block.labels[slot][block.learns(i)]
                    sums[i] += (len(y), y.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(slots), dtype=np.int32)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["model", "n", "y"])

    found = {r["model"]: (r["n"], r["y"]) for r in blocks.mapInArrow(add, "model int, n double, y double").groupBy("model").agg(
        F.sum("n").alias("n"), F.sum("y").alias("y")).collect()}  # a row a model
    out = []
    for i, s in enumerate(specs):
        n, y = found.get(i, (0.0, 0.0))
        weight = (n - y) / y if s.balanced and 0 < y < n else 1.0
        mean = y / n if n else 0.0
        if s.objective == "tweedie":
            base = float(np.log(mean)) if mean > 0 else 0.0
        else:
            odds = (y * weight + 1e-9) / (n - y + 1e-9)
            base = float(np.log(odds)) if n else 0.0
        out.append((base, weight, n))
    return out


# ---- growing

def _grow_in_task(blocks: DataFrame, growths: Sequence[Growth], features: int) -> list[Forest]:
    """Every model grows in a task of its own, which reads all blocks."""
    def grow(model: int, rows: Iterator[Row]) -> Iterator[tuple[int, Forest]]:
        held = []
        for row in rows:
            block = _Block.of(row, features)
            held.append((block.number, block.bins.T, block.labels[growths[model].slot].copy(), block.learns(model)))
        if held:
            held.sort(key=lambda h: h[0])
            numbers = [(h[0], len(h[2])) for h in held]
            bins, y, learnt = (np.concatenate([h[i] for h in held]) if len(held) > 1 else held[0][i] for i in (1, 2, 3))
            held.clear()
            yield model, _grown(growths[model], bins.T, y, learnt, numbers).forest

    read = blocks.coalesce(1).rdd  # once for each model: nothing is shuffled
    forests = dict(blocks.sparkSession.sparkContext.union([read] * len(growths)).mapPartitionsWithIndex(grow).collect())  # a row a model
    return [forests.get(i, growth.forest) for i, growth in enumerate(growths)]


def _grown(growth: Growth, bins: np.ndarray, y: np.ndarray, learnt: np.ndarray, blocks: Sequence[tuple[int, int]]) -> Growth:
    """All trees of a model from all its rows, which are those of ``blocks`` (number, rows) in order."""
    margin = np.full(len(y), growth.base)
    bundles = Bundles.of(bins) if growth.differs else None
    while not growth.done:
        tree, order = growth.tree, growth.order()
        rows = order.rows(bins, margin, y, learnt, *blocks)
        rows.bundles = bundles
        rows.keep(order)
        while growth.tree == tree:
            order = growth.order()
            if order.level:
                rows.step(order.forest)
            growth.take(_chosen(growth, rows.sums(order)))
        grown = growth.forest.part(tree, tree + 1)
        rows.step(grown, growth.settings.depth - order.level)
        margin[rows.rows] += grown.value[0][rows.node]
        others = learnt.copy()
        others[rows.rows] = False
        others = np.flatnonzero(others)
        margin[others] += grown.value[0][grown.place(bins, 0, growth.settings.depth, rows=others)]
    return growth


def _models_fill(rows: float, models: int, cores: int) -> bool:
    """Whether a task a model can hold the rows and the models keep three quarters of the cores busy."""
    return rows <= MODEL_BLOCKS * BLOCK_ROWS and 4 * models >= 3 * cores


def _held(blocks: DataFrame, growths: Sequence[Growth], features: int, tasks: int) -> RDD:
    """The blocks, dealt to as many tasks as there are cores, with the margins written with them or the base."""
    bases = [g.base for g in growths]

    def block(row: Row) -> tuple[int, _Block]:
        own = _Block.of(row, features)
        own.member = own.member.astype(np.min_scalar_type(2 ** len(bases) - 1))
        own.margins = np.stack([np.full(row["n"], x) for x in bases]) if row["margins"] is None else np.frombuffer(row["margins"]).reshape(len(bases), -1)
        return own.number, own

    if "margins" not in blocks.columns:
        blocks = blocks.withColumn("margins", F.lit(None).cast("binary"))
    return blocks.rdd.map(block).partitionBy(tasks, lambda number: (number >> 32) % tasks).values().persist(StorageLevel.MEMORY_AND_DISK)


def _advanced(held: RDD, growths: Sequence[Growth], tree: int) -> RDD:
    """The blocks with the margins after one more tree."""
    grown = [g.forest.part(tree, tree + 1) for g in growths]

    def add(block: _Block) -> _Block:
        return _Block(block.number, block.bins, block.labels, block.member, np.stack([m + f.margin(block.bins) for m, f in zip(block.margins, grown)]))

    return held.map(add).persist(StorageLevel.MEMORY_AND_DISK)


def _written(held: RDD, spark: SparkSession) -> DataFrame:
    """The blocks with their margins as a table in the shared folder."""
    rows = held.map(lambda b: (b.number, b.bins.shape[1], *[bytearray(x.tobytes()) for x in (b.bins.T, b.labels, b.member.astype(np.int64), b.margins)]))
    return materialize(spark.createDataFrame(rows, _BLOCKS + ", margins binary"))


@cache
def _settled() -> None:
    """Workers collect garbage after every task; what one has imported by its first pass is not looked at again."""
    gc.freeze()


def _level_pass(held: RDD, growths: Sequence[Growth], busy: Sequence[int], cuts: Sequence[int], tasks: int) -> dict[int, list[tuple]]:
    """Best splits of the open nodes of the models in ``busy``; ``cuts`` is the number of cuts of each feature."""
    orders = {i: growths[i].order() for i in busy}

    def size() -> int:
        return sum(len(o.open) * (cuts[int(f)] + 2) * 16 for o in orders.values() for f in o.columns)

    here = size() * tasks <= SUMS_BYTES  # the sums of all tasks
    if not here:  # sums stay where they meet: the next level has none to subtract from
        for i in busy:
            growths[i].known = None
        orders = {i: growths[i].order() for i in busy}
    keys = {key: at for at, key in enumerate((i, int(f)) for i, o in orders.items() for f in o.columns)}

    def local(blocks: Iterator[_Block]) -> Iterator[tuple[int, np.ndarray]]:
        _settled()
        sums: dict[int, np.ndarray] = {}
        for b in blocks:
            for i, o in orders.items():
                own = o.rows(b.bins, b.margins[i], b.labels[o.slot], b.learns(i), (b.number, b.bins.shape[1])).sums(o)
                sums[i] = own + sums[i] if i in sums else own
        for i, s in sums.items():
            for c, f in enumerate(orders[i].columns):  # codes that do not occur are left out
                yield keys[i, int(f)], np.append(s[:, :, c, :cuts[f] + 1], s[:, :, c, MISSING:], axis=-1)

    def together(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}  # a share of models x features
        for key, own in parts:
            sums[key] = sums[key] + own if key in sums else own
        for key, s in sums.items():
            whole = np.zeros((*s.shape[:2], 256))
            whole[:, :, :s.shape[2] - 1], whole[:, :, MISSING] = s[:, :, :-1], s[:, :, -1]
            yield key, whole

    def merged(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, tuple]]:
        _settled()
        return ((key, best_splits(whole)) for key, whole in together(parts))

    if here:
        sums = dict(together(iter(held.mapPartitions(local).collect())))  # at most SUMS_BYTES
        return {i: _chosen(growths[i], np.stack([sums[keys[i, int(f)]] for f in o.columns], axis=2)) for i, o in orders.items()}
    reducers = min(tasks, len(keys), -(-size() * tasks // SUMS_BYTES))
    found = dict(held.mapPartitions(local).partitionBy(reducers, lambda key: key % reducers).mapPartitions(merged).collect())  # a row for each model and feature
    out = {}
    for i, o in orders.items():
        gain, cut, missing_left, gl, hl, g, h = (np.stack(x, axis=1) for x in zip(*[found[keys[i, int(f)]] for f in o.columns]))
        out[i] = _picked(o.open, o.columns, (gain, cut, missing_left, gl, hl, g, h))
    return out


def _grow_across_blocks(blocks: DataFrame, growths: Sequence[Growth], features: int, cuts: Sequence[int]) -> list[Forest]:
    """One pass a level: tasks add up their blocks, sums meet by model and feature."""
    spark, trees = blocks.sparkSession, growths[0].settings.trees
    tasks = min(spark.sparkContext.defaultParallelism, blocks.count())
    held, before = _held(blocks, growths, features, tasks), None
    for tree in range(trees):
        if tree and tree % REFRESH == 0:
            table = _written(held, spark)
            held.unpersist()
            held = _held(table, growths, features, tasks)
        while busy := [i for i, g in enumerate(growths) if g.tree == tree]:
            splits = _level_pass(held, growths, busy, cuts, tasks)
            for i, own in splits.items():
                growths[i].take(own)
            if before is not None:  # the first pass of a tree has brought the margins on
                before.unpersist()
                before = None
        if tree + 1 < trees:
            held, before = _advanced(held, growths, tree), held
    held.unpersist()
    return [g.forest for g in growths]


# ---- models

@dataclass
class BoostedModel:
    """A fitted ensemble: ``transform`` adds ``margin`` and ``prediction`` (a probability, or a mean)."""

    features: list[str]
    objective: str
    base: float
    cuts: list[np.ndarray]
    forest: Forest
    categories: PipelineModel | None = None
    label: str = field(default="label")

    def inputs(self, df: DataFrame) -> DataFrame:
        return self.categories.transform(df) if self.categories else df

    def transform(self, df: DataFrame) -> DataFrame:
        margin = margin_column([self])(F.lit(0), *[F.col(f).cast("double") for f in self.features])
        out = self.inputs(df).withColumn("margin", margin).withColumn("prediction", response(self.objective, F.col("margin")))
        return out.select(*[c for c in df.columns if c not in ("margin", "prediction")], "margin", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        f = self.forest
        row = (self.features, self.objective, self.base, [c.tolist() for c in self.cuts], list(f.feature.shape), *[getattr(f, c).ravel().tolist() for c in _ARRAYS], self.label)
        spark.createDataFrame([row], _STORED).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        if self.categories:
            self.categories.write().overwrite().save(f"{path}/categories")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        r = spark.read.parquet(f"{path}/trees").first()
        shape, empty = tuple(r["shape"]), Forest.empty(1, 1)
        forest = Forest(*(np.array(r[c], getattr(empty, c).dtype).reshape(shape) for c in _ARRAYS))
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/categories")
        known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        return BoostedModel(r["features"], r["objective"], r["base"], [np.array(c) for c in r["cuts"]], forest,
                            PipelineModel.load(f"{path}/categories") if known else None, r["label"])


_STORED = ("features array<string>, objective string, base double, cuts array<array<double>>, shape array<int>, feature array<int>, cut array<int>, "
           "missing_left array<boolean>, value array<double>, cover array<double>, gain array<double>, label string")


def response(objective: str, margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin)) if objective == "logistic" else F.exp(margin)


def margin_column(models: Sequence[BoostedModel]):
    """A column function (number of the model, *features) -> margin; the ensembles travel with it.

    Their size is bounded by trees x nodes of a tree, about a megabyte for 400 trees of depth 5.
    """
    plain = [(m.base, m.cuts, m.forest) for m in models]

    @F.pandas_udf("double")
    def margin(which: pd.Series, *columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(np.float64, na_value=np.nan) for c in columns]
        number = which.to_numpy()
        out = np.full(len(number), np.nan)
        for i in np.unique(number):
            rows = number == i
            base, cuts, forest = plain[int(i)]
            out[rows] = base + forest.margin(codes([v[rows] for v in values], cuts))
        return pd.Series(out)

    return margin


def fit_many(df: DataFrame, features: Sequence[str], specs: Sequence[Spec], settings: Settings = Settings(), categories: Sequence[str] = ()) -> list[BoostedModel]:
    """Fit all ``specs`` in one scan; category columns are ordered by how often a level occurs."""
    if len(specs) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models in a scan")
    indexer, names = None, list(features)
    if categories:
        indexed = [f"{c}_index" for c in categories]
        indexer = Pipeline(stages=[StringIndexer(inputCols=list(categories), outputCols=indexed, handleInvalid="keep")]).fit(df)
        df, names = indexer.transform(df), names + indexed
    labels = list(dict.fromkeys(s.label for s in specs))
    learnt = df.where(" OR ".join(f"`{c}` IS NOT NULL" for c in labels))
    cuts = feature_cuts(learnt, names)
    blocks = binned_blocks(learnt, names, labels, specs, cuts)
    starts = _starts(blocks, specs, labels, len(names))
    growths = [Growth(s, labels.index(s.label), settings, len(names), *start) for s, start in zip(specs, starts)]
    stored = blocks.agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).first()
    if stored["blocks"] <= 1 or _models_fill(stored["n"], len(specs), df.sparkSession.sparkContext.defaultParallelism):
        forests = _grow_in_task(blocks, growths, len(names))
    else:
        forests = _grow_across_blocks(blocks, growths, len(names), [len(c) for c in cuts])
    return [BoostedModel(names, s.objective, base, cuts, forest, indexer, s.label) for s, (base, *_), forest in zip(specs, starts, forests)]


def out_of_fold(df: DataFrame, models: Sequence[BoostedModel], fold: str = "fold") -> DataFrame:
    """Score every row by the model of its fold: adds ``margin`` and ``prediction``."""
    first = models[0]
    margin = margin_column(models)(F.col(fold), *[F.col(f).cast("double") for f in first.features])
    out = first.inputs(df).withColumn("margin", margin).withColumn("prediction", response(first.objective, F.col("margin")))
    return out.select(*[c for c in df.columns if c not in ("margin", "prediction")], "margin", "prediction")


def importance(model: BoostedModel, spark: SparkSession) -> DataFrame:
    """Share of the total gain of each feature."""
    total = np.zeros(len(model.features))
    used = model.forest.feature >= 0
    np.add.at(total, model.forest.feature[used], model.forest.gain[used])
    total = total / total.sum() if total.sum() else total
    return spark.createDataFrame([(f, float(v)) for f, v in zip(model.features, total)], "feature string, importance double").orderBy(F.desc("importance"))
