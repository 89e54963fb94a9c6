"""Benchmark decontamination by the q-gram lemma in overlapping diagonal bands.

Texts and benchmark items are compared as UTF-8 bytes, ASCII lower-cased, white space runs as one space.
An occurrence of an item of m bytes with at most e = floor(EDITS * m) edits shares at least
m - q + 1 - q * e of its q-grams with the text, all within e of one diagonal. Diagonals are cut into
bands of width 2e + 1 that overlap by half and more, so every such occurrence lies whole in a band; a band with
too few shared q-grams is dropped, the others are verified by banded alignment (edit distance with
free ends in the text). Nothing longer than a text's own hits is held.

An item of which the lemma promises nothing with q = ``Q`` uses the largest q that promises one shared q-gram; items
below ``Q`` bytes are searched exactly, as they allow no edit. Q-grams that an item repeats more than ``REPEATS`` times
are left out of its count, and of the bound; an item made of such repetitions is aligned along all diagonals
around its q-grams instead. Hits are counted in windows of the text, so runs of one character take neither memory
nor time beyond their length.

The benchmark is normalised and folded on Spark and broadcast in blocks of about ``BLOCK_BYTES``; every block is compared
with all texts, and what it finds is written before the next. Null and empty texts hold no item; null items and items
without text are ignored; repeated items count once, under the smallest id. Repeated documents are judged
alike; rows with a null doc_id are judged too; further columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import map_batches, materialize

EDITS = 0.08
Q = 8  # a q-gram is one 64-bit integer
REPEATS = 16
PAIRS = 1_000_000  # of a text's and an item's q-grams counted at once
WIDTH = 65_536  # diagonals aligned at once
BLOCK_BYTES = 4 << 20
_BITS = 22


def grams(data: bytes, q: int = Q) -> np.ndarray:
    """Every q consecutive bytes as an integer."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    values = np.ndarray((len(data) - q + 1,), "<u8", data + bytes(Q - q), strides=(1,))
    return values if q == Q else values & np.uint64((1 << 8 * q) - 1)


def gram_size(length: int, edits: int) -> int:
    """The largest q up to ``Q`` for which an item shares a q-gram with each of its occurrences."""
    return min(Q, length // (edits + 1))


def _slot(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def normal(text: str | None) -> bytes:
    """ASCII lower case, white space runs as one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


class Index:
    """Items of a block by the q they use."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.floor(EDITS * self.length).astype(np.int64)
        sizes = [gram_size(int(n), int(e)) for n, e in zip(self.length, self.edits)]
        self.parts = [_Grams(q, [i for i, s in enumerate(sizes) if s == q], self.texts, self.length, self.edits) for q in sorted(set(sizes))]

    def regions(self, data: bytes) -> list[tuple[int, int, int]]:
        """(item, first, last): diagonals of the bands with enough shared q-grams."""
        return sorted({region for part in self.parts for region in part.regions(data)})


class _Grams:
    """Q-grams of items that use the same q, sorted."""

    def __init__(self, q: int, items: list[int], texts: list[bytes], length: np.ndarray, edits: np.ndarray):
        self.q, self.length, self.edits = q, length, edits
        self.least = np.maximum(1, length - q + 1 - q * edits)
        values, item, place, dense, dense_item = [], [], [], [], []
        for i in items:
            own = grams(texts[i], q)
            _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
            often = count[inverse] > REPEATS
            if self.least[i] - often.sum() >= 1:
                self.least[i] -= often.sum()
                rare = np.flatnonzero(~often)
                values.append(own[rare])
                place.append(rare)
                item.append(np.full(len(rare), i))
            else:
                dense.append(np.unique(own))
                dense_item.append(np.full(len(dense[-1]), i))

        def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
            return np.concatenate([np.empty(0, kind), *parts])

        whole = joined(values, np.uint64)
        order = np.argsort(whole, kind="stable")
        self.values, self.item, self.place = whole[order], joined(item, np.int64)[order], joined(place, np.int64)[order]
        self.dense, self.dense_item = joined(dense, np.uint64), joined(dense_item, np.int64)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[_slot(self.values)] = True
        self.seen[_slot(self.dense)] = True
        self.reach = int((length[items] + edits[items]).max(initial=0))  # of an occurrence in the text

    def regions(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        values = grams(data, self.q)
        at = np.flatnonzero(self.seen[_slot(values)])
        if not len(at):
            return
        low = np.searchsorted(self.values, values[at], "left")
        many = np.searchsorted(self.values, values[at], "right") - low
        upto = np.concatenate(([0], np.cumsum(many)))
        start = 0
        while start < len(at) and upto[-1] > upto[start]:
            # as far as the pairs allow, but so that every occurrence lies whole in a window
            stop = max(int(np.searchsorted(upto, upto[start] + PAIRS)), int(np.searchsorted(at, at[start] + 2 * self.reach)) + 1)
            stop = min(stop, len(at))
            yield from self._counted(at[start:stop], low[start:stop], many[start:stop])
            if stop == len(at):
                break
            start = max(start + 1, int(np.searchsorted(at, at[stop - 1] - self.reach)))
        for i in np.unique(self.dense_item).tolist():
            yield from self._around(i, at[np.isin(values[at], self.dense[self.dense_item == i])])

    def _counted(self, at: np.ndarray, low: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Bands with enough q-grams among the given places of a text."""
        at = np.repeat(at, many)
        row = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(at))
        item, diagonal = self.item[row], at - self.place[row]
        step = self.edits[item] + 1  # bands of 2 * step start at every step: they overlap by half
        base = item.astype(np.int64) << 40 | (np.floor_divide(diagonal, step) + (1 << 32))
        key, place = np.concatenate((base, base - 1)), np.tile(self.place[row], 2)  # a diagonal is in two bands
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        full = count[inverse] >= self.least[key >> 40]
        if not full.any():
            return
        # a q-gram of the item counts once in a band, however often the text repeats it
        pairs = np.unique(np.stack((key[full], place[full])), axis=1)[0]
        band, count = np.unique(pairs, return_counts=True)
        which = band >> 40
        enough = count >= self.least[which]
        for b, i in zip(band[enough].tolist(), which[enough].tolist()):
            first = ((b & ((1 << 40) - 1)) - (1 << 32)) * int(self.edits[i] + 1)
            yield i, first, first + 2 * int(self.edits[i] + 1) - 1

    def _around(self, item: int, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """All diagonals on which an occurrence may hold one of the places."""
        if not len(at):
            return
        length = int(self.length[item])
        cuts = np.flatnonzero(np.diff(at) > length) + 1
        for near in np.split(at, cuts):
            for first in range(int(near[0]) - length, int(near[-1]) + 1, WIDTH):
                yield item, first, min(first + WIDTH - 1, int(near[-1]))


def align(item: bytes, data: bytes, first: int, last: int, edits: int) -> tuple[int, int] | None:
    """(end, distance) of the best occurrence whose path stays near diagonals first..last; None above ``edits``."""
    low, width = first - edits, last - first + 2 * edits + 1
    text = np.frombuffer(data, np.uint8).astype(np.int16)
    columns = np.arange(width)
    # row r, column k stands for the text end r + low + k; the start is free
    ends = low + columns
    cost = np.where((ends >= 0) & (ends <= len(text)), 0, edits + 1).astype(np.int32)
    for r, byte in enumerate(item):
        ends = r + 1 + low + columns
        ok = (ends >= 1) & (ends <= len(text))
        same = np.zeros(width, bool)
        same[ok] = text[ends[ok] - 1] == byte
        step = np.where(ok, cost + ~same, edits + 1)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        step = np.where((ends >= 0) & (ends <= len(text)), step, edits + 1)
        cost = np.minimum.accumulate(step - columns) + columns  # moves along the row
        if cost.min() > edits:
            return None
    best = int(cost.argmin())
    return (len(item) + low + best, int(cost[best])) if cost[best] <= edits else None


def matches(index: Index, text: str | None) -> list[tuple[int, int]]:
    """(item id, distance) of the items that occur in the text."""
    data = normal(text)
    best: dict[int, int] = {}
    for item, first, last in index.regions(data):
        if index.ids[item] in best and best[index.ids[item]] == 0:
            continue
        if got := align(index.texts[item], data, first, last, int(index.edits[item])):
            best[index.ids[item]] = min(got[1], best.get(index.ids[item], got[1]))
    return sorted(best.items())


def usable(benchmark: DataFrame) -> DataFrame:
    """(item_id, text): normalised items with text, one for each text, under the smallest id."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal(t) for t in batch.column(1).to_pylist()], pa.binary())], ["item_id", "text"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = map_batches(rows.where("item_id IS NOT NULL AND text IS NOT NULL"), run, "item_id long, text binary")
    return found.where("length(text) > 0").groupBy("text").agg(F.min("item_id").alias("item_id"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, items (list of item ids), least_edits, contaminated for every row of ``docs``."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = _with_hits(columns, benchmark)
    return hits.select(
        "doc_id", F.size("hits").cast("long").alias("n_items"), F.sort_array(F.col("hits.item")).alias("items"),
        F.array_min(F.col("hits.edits")).alias("least_edits"), (F.size("hits") > 0).alias("contaminated"))


def _with_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminations removed, plus the array ``hits`` (item, edits), one pass for each block."""
    spark, names = docs.sparkSession, docs.columns
    out = docs.withColumn("hits", F.expr("array()").cast("array<struct<item:long,edits:long>>"))
    items = materialize(usable(benchmark))
    blocks = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // BLOCK_BYTES + 1
    passes = 0
    for number in range(blocks):
        block = sorted((r["item_id"], bytes(r["text"])) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number).collect())  # about BLOCK_BYTES
        if not block:
            continue
        if passes:
            out = materialize(out)  # else each block would be one more index in the same workers
        passes += 1
        out = map_batches(out, _finder(spark.sparkContext.broadcast(block)), out.schema)
    return out.select(*names, "hits")


def _finder(shared: Broadcast) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Adds what one block finds to ``hits``, the last column."""
    kept: list[Index] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            kept.append(Index(shared.value))
        at = batch.schema.names.index("text")
        found = [[{"item": i, "edits": e} for i, e in matches(kept[0], t)] for t in batch.column(at).to_pylist()]
        old = batch.column(batch.num_columns - 1).to_pylist()
        both = pa.array([a + b for a, b in zip(old, found)], pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int64())])))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], both], batch.schema.names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    hit = "contamination hits"
    texts = _with_hits(docs, benchmark) if "hits" not in docs.columns else _with_hits(docs.withColumnRenamed("hits", hit), benchmark)
    return texts.where(F.size("hits") == 0).drop("hits").withColumnRenamed(hit, "hits")
