"""Ranked lexical search with Block-Max MaxScore over sharded inverted lists.

Index (``build_index``): each task cuts its documents into shards of about ``SHARD_BYTES`` of text. A shard
has one row with its documents and their lengths, and one row for each of its terms: blocks of ``BLOCK``
postings (document number, occurrences) as variable-length bytes, and beside them, uncompressed, the last
document, the end in bytes and the *best pairs* of each block: those (occurrences, length) that no other
posting of the block beats in both. A score grows with the occurrences and falls with the length, so the
best pairs give the exact maximum of a block whatever the statistics of the whole collection turn out to be.

Search (``search``): items are cut into sets of about ``SET_TERMS`` terms; a set is all that is ever broadcast.
For a set, the document frequencies of its terms are added up over shards, its lists are grouped by shard, and
each shard answers each item by Block-Max MaxScore, in windows of documents:

* the lists are ordered by their greatest contribution; those whose maxima together stay below the item's
  k-th best score so far are non-essential, the others essential (all are, at first);
* only documents of essential lists are candidates; what the non-essential lists can add at most is read from
  the maxima of the blocks where the candidate would stand, and candidates that fall short are rejected before
  any of those blocks is decompressed;
* the non-essential lists are then opened from the strongest down, only in blocks with candidates left, and
  candidates are rejected again after each; the rest have their exact scores and enter the heap.

The k best of every shard, k rows an item and shard, are merged by a window that keeps k rows a task before it
shuffles. All scores are 64-bit integers; equal scores go by the smaller doc_id, so a candidate is rejected
only when it stays *below* the k-th score.

Null texts have no terms. All rows count in the statistics; rows with a null doc_id are never returned, rows
that share a doc_id are separate documents. Items with a null item_id or without terms have no answer; rows of
an item that are equal are answered once, different texts of one item_id each on their own. A document longer
than ``SHARD_BYTES`` is a shard of its own. Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.frames import BATCH_BYTES, map_batches, materialize
from ledgerlens.llm.terms import dictionary_terms

SHARD_BYTES = 8_000_000
BLOCK = 128  # postings
WINDOW = 2048  # documents scored at once
SET_TERMS = 50_000
LIST_SCHEMA = "shard long, term string, n_docs long, postings binary, last binary, ends binary, pairs binary, pair_ends binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value): seven bits a byte, low bits first, the high bit set but in the last byte."""
    values = values.astype(np.int64)
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >> bits > 0
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = sizes > k
        out[(ends - sizes)[has] + k] = (values[has] >> 7 * k & 127) | np.where(sizes[has] > k + 1, 128, 0)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The values of ``pack``."""
    if not len(data):
        return np.empty(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(data < 128)[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data.astype(np.int64) & 127) << 7 * place, starts)


def _slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the consecutive pieces of ``data`` that stop at ``ends`` (in items)."""
    offsets = np.concatenate(([0], ends)).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def shard_lists(shard: int, texts: pa.Array) -> tuple[pa.RecordBatch, np.ndarray]:
    """The inverted lists of one shard, and the length in terms of each of its documents."""
    terms, index, lengths = dictionary_terms(texts)
    n = max(1, len(lengths))
    code, tf = np.unique(index * n + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    term, doc = np.divmod(code, n)
    used, first, df = np.unique(term, return_index=True, return_counts=True)
    within = np.arange(len(term)) - np.repeat(first, df)
    head = within % BLOCK == 0  # first postings of blocks
    block = np.cumsum(head) - 1
    tail = np.append(head[1:], True)[:len(head)]
    # documents as distances from the one before, from zero at the start of a block's list
    gap = np.where(within == 0, doc, doc - np.roll(doc, 1))
    data, ends = pack(np.stack([gap, tf], axis=1).ravel())
    ends = ends[1::2]
    list_end = np.cumsum(df) - 1
    list_bytes = ends[list_end] if len(ends) else ends
    block_term = term[head]
    blocks_of = np.searchsorted(block_term, used, side="right")
    start_byte = np.concatenate(([0], list_bytes))[:-1]
    own_end = ends[tail] - np.repeat(start_byte, np.diff(np.concatenate(([0], blocks_of))))
    # best pairs: by falling occurrences, those shorter than all before them in the block
    order = np.lexsort((lengths[doc], -tf, block))
    b, size = block[order], lengths[doc][order]
    far = int(size.max(initial=0)) + 1
    lowest = np.minimum.accumulate(size - b * far) + b * far
    best = np.concatenate(([True], (b[1:] != b[:-1]) | (size[1:] < lowest[:-1])))[:len(b)]
    pairs = np.stack([tf[order][best], size[best]], axis=1).astype("<u4")
    pair_ends = np.cumsum(np.bincount(b[best], minlength=int(head.sum())))
    list_pairs = pair_ends[blocks_of - 1] if len(used) else pair_ends
    own_pair_end = pair_ends - np.repeat(np.concatenate(([0], list_pairs))[:-1], np.diff(np.concatenate(([0], blocks_of))))
    batch = pa.RecordBatch.from_arrays([
        pa.array(np.full(len(used), shard, np.int64)), terms.take(pa.array(used)), pa.array(df.astype(np.int64)),
        _slices(data, list_bytes), _slices(doc[tail].astype("<u4"), blocks_of), _slices(own_end.astype("<u4"), blocks_of),
        _slices(pairs.reshape(-1), list_pairs * 2), _slices(own_pair_end.astype("<u4"), blocks_of)],
        ["shard", "term", "n_docs", "postings", "last", "ends", "pairs", "pair_ends"])
    return batch, lengths


def build_index(docs: DataFrame) -> DataFrame:
    """One row a shard and term as in ``LIST_SCHEMA``; the row with a null term has the documents of its shard.

    That row has their number as ``n_docs``, ids (64-bit, with ``last`` 1 where the id is null) as
    ``postings`` and lengths (32-bit) as ``ends``. Shards are numbered by partition, so the result must
    be written once before it is used.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            lists, lengths = shard_lists(number, table.column(1).chunk(0))
            ids = table.column(0)
            own = [np.frombuffer(x, np.uint8).tobytes() for x in (
                ids.fill_null(0).to_numpy().astype("<i8"), ids.is_null().to_numpy().astype(np.uint8), lengths.astype("<u4"))]
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([None], pa.string()), pa.array([len(lengths)]), pa.array([own[0]], pa.binary()),
                pa.array([own[1]], pa.binary()), pa.array([own[2]], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], lists.schema.names)
            for lo in range(0, lists.num_rows, 50_000):
                yield lists.slice(lo, 50_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and size + batch.nbytes > SHARD_BYTES:
                yield from shard()
                number, held, size = number + 1, [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from shard()

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, LIST_SCHEMA)


class Statistics(NamedTuple):
    """Documents with terms and all their terms; weight of each term of a set of items."""

    documents: int
    terms: int
    weight: Mapping[str, int]

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        return 25 + (75 * lengths.astype(np.int64) * self.documents) // max(1, self.terms)


def gain(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * norm)


class PostingList:
    """One list of a shard: block maxima at once, postings when asked for."""

    def __init__(self, row: Mapping[str, bytes], norm: np.ndarray, statistics: Statistics):
        self.data = np.frombuffer(row["postings"], np.uint8)
        self.last, self.ends, pair_ends = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("last", "ends", "pair_ends"))
        pairs = np.frombuffer(row["pairs"], "<u4").reshape(-1, 2)
        self.norm = norm
        best = gain(pairs[:, 0], statistics.norm(pairs[:, 1]))
        self.most = np.maximum.reduceat(best, np.concatenate(([0], pair_ends[:-1])))  # of each block
        self.bound = int(self.most.max())
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of a block; opened once."""
        if b not in self._open:
            values = unpack(self.data[self.ends[b - 1] if b else 0:self.ends[b]])
            doc = np.cumsum(values[::2]) + (self.last[b - 1] if b else 0)
            self._open[b] = (doc, gain(values[1::2], self.norm[doc]))
        return self._open[b]

    def opened(self) -> int:
        return len(self._open)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by falling score, then rising id."""
    return np.lexsort((ids, -scores))[:k]


def answer(lists: Sequence[tuple[int, PostingList]], ids: np.ndarray, real: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_ids, scores) of the k best documents of a shard; ``lists`` has the factor and list of each distinct term."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].bound)
    bounds = np.cumsum([a * p.bound for a, p in lists])
    found_ids, found = np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(ids)
    for lo in range(0, n, WINDOW):
        hi = min(n, lo + WINDOW)
        floor = int(found[-1]) if len(found) == k else 1  # scores of 0 are no answers
        free = int(np.searchsorted(bounds, floor))  # so many lists stay below it together
        if free == len(lists):
            break
        score = np.zeros(hi - lo, np.int64)
        for a, p in lists[free:]:
            b = int(np.searchsorted(p.last, lo))
            while b < len(p.last) and (b == 0 or p.last[b - 1] < hi - 1):
                doc, gains = p.block(b)
                i, j = np.searchsorted(doc, (lo, hi))
                score[doc[i:j] - lo] += a * gains[i:j]
                b += 1
        place = np.flatnonzero((score > 0) & real[lo:hi])
        score = score[place]
        place = place + lo
        # what each non-essential list can still add, by the block a candidate would be in
        where, rest = [], []
        for a, p in lists[:free]:
            b = np.searchsorted(p.last, place)
            where.append(b)
            rest.append(a * np.append(p.most, 0)[b])
        left = sum(rest, np.zeros(len(place), np.int64))
        alive = np.flatnonzero(score + left >= floor)
        for i in range(free - 1, -1, -1):
            if not len(alive):
                break
            a, p = lists[i]
            left[alive] -= rest[i][alive]
            own = where[i][alive]
            for b in np.unique(own[own < len(p.last)]).tolist():
                doc, gains = p.block(b)
                asked = alive[own == b]
                at = np.minimum(np.searchsorted(doc, place[asked]), len(doc) - 1)
                score[asked] += np.where(doc[at] == place[asked], a * gains[at], 0)
            alive = alive[score[alive] + left[alive] >= floor]
        if len(alive):
            found_ids, found = np.append(found_ids, ids[place[alive]]), np.append(found, score[alive])
            keep = _best(found, found_ids, k)
            found_ids, found = found_ids[keep], found[keep]
    return found_ids, found


def search_shard(rows: pa.Table, items: Sequence[tuple[int, int, Mapping[str, int]]], statistics: Statistics, k: int) -> pa.Table:
    """(query, item_id, doc_id, score): the k best documents of one shard for every item."""
    rows = rows.to_pylist()
    own = next(r for r in rows if r["term"] is None)
    ids = np.frombuffer(own["postings"], "<i8")
    real = np.frombuffer(own["last"], np.uint8) == 0
    norm = statistics.norm(np.frombuffer(own["ends"], "<u4"))
    lists = {r["term"]: PostingList(r, norm, statistics) for r in rows if r["term"] is not None}
    out = []
    for query, item_id, terms in items:
        chosen = [(times * statistics.weight[t], lists[t]) for t, times in terms.items() if t in lists and statistics.weight[t] > 0]
        docs, scores = answer(chosen, ids, real, k) if chosen else (ids[:0], ids[:0])
        out.append((np.full(len(docs), query, np.int64), np.full(len(docs), item_id, np.int64), docs, scores))
    columns = [np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(4)]
    return pa.table(dict(zip(("query", "item_id", "doc_id", "score"), map(pa.array, columns))))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the terms of every distinct item, in order and with repeats."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, index, lengths = dictionary_terms(batch.column(1))
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, terms.take(pa.array(index)))], ["item_id", "terms"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts.where("item_id IS NOT NULL AND text IS NOT NULL").distinct(), run, "item_id long, terms array<string>")


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item; ``index`` is a written ``build_index``."""
    spark = index.sparkSession
    totals = index.where("term IS NULL").select(F.col("ends")).mapInArrow(_lengths, "documents long, terms long").agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    asked = materialize(item_terms(items).withColumn("query", F.monotonically_increasing_id()))
    size = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    sets = size // SET_TERMS + 1
    found = None
    for number in range(sets):
        rows = asked.where((F.pmod(F.xxhash64("query"), F.lit(sets)) == number) & (F.size("terms") > 0)).collect()  # about SET_TERMS terms
        if not rows:
            continue
        each = [(r["query"], r["item_id"], {t: r["terms"].count(t) for t in set(r["terms"])}) for r in rows]
        vocabulary = spark.createDataFrame([(t,) for t in sorted({t for _, _, terms in each for t in terms})], "term string")
        lists = index.join(F.broadcast(vocabulary), "term", "left_semi")
        counts = {r["term"]: r["df"] for r in lists.groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}  # of this set's terms
        weight = {t: math.floor(1000 * math.log((2 * totals["documents"] + 2) / (2 * df + 1))) for t, df in counts.items()}
        statistics = Statistics(totals["documents"], totals["terms"], weight)
        whole = lists.select(*index.columns).union(index.where("term IS NULL"))
        best = whole.groupBy("shard").applyInArrow(_searcher(each, statistics, k), "query long, item_id long, doc_id long, score long")
        best = _merged(best, k) if sets == 1 else materialize(_merged(best, k))
        found = best if found is None else found.union(best)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _searcher(items: Sequence[tuple[int, int, Mapping[str, int]]], statistics: Statistics, k: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        return search_shard(rows, items, statistics, k)

    return run


def _merged(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())],
                                         ["documents", "terms"])


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index ``docs`` in the shared folder and search it for ``items``."""
    return search(materialize(build_index(docs)), items, k)


SQL = r"""
WITH terms AS (
    SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), lengths AS (
    SELECT doc_id, len(w)::BIGINT AS n FROM terms WHERE len(w) > 0
), totals AS (
    SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), postings AS (
    SELECT doc_id, term, count(*)::BIGINT AS tf
    FROM (SELECT doc_id, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM terms) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, n_docs
), asked AS (
    SELECT item_id, term, count(*)::BIGINT AS times FROM (
        SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
        FROM benchmark) GROUP BY ALL
), scored AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
