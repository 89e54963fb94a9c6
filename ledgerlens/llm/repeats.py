"""Removal of byte strings that an earlier document already has, by column-wise construction of the sorted
order and common prefixes of many short strings.

All texts are UTF-8 bytes. A byte goes when a 50-byte string over it also starts in a document with a
smaller doc_id. Sorting every suffix would shuffle the text fifty times over, so a content-chosen sample of
positions stands for all: of the 31 20-grams in a 50-byte string the one with the smallest hash is its
anchor, hence equal strings have anchors at equal places. Then:

0. a text of 50 bytes or more that an earlier document has whole goes at once (digests decide), and
   takes no part below: whatever it holds, the earlier document holds;
1. shards of documents tell buckets which anchor 20-grams they have, once a shard; those in one document
   only are dropped;
2. shards send the distinct 80-byte surroundings of the other anchors, with the smallest and largest
   document that has them, so a passage of very many documents costs one row a shard;
3. a bucket builds the order of its surroundings column by column from the right: each round inserts
   one symbol of every string, re-sorts the previous order by it (stable, within an anchor's group) and
   updates the common prefixes of neighbours from those of the round before. Columns lie in an external
   file and are read one after the other. At the 31 rounds where 50-byte strings start, neighbours with a
   common prefix of 50 or more are equal, and the smallest document of each run of equals is noted;
4. shards compare their documents with these, cut the bytes and hash what is left.

Null and short texts lose nothing. Rows with a null doc_id take no part and lose nothing. Rows that share
a doc_id are compared with other documents, not with each other. Further columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import map_batches, materialize, partitions_for
from ledgerlens.llm.hashing import mix, prefix_sums, substring_hashes

LENGTH, GRAM = 50, 20
_WINDOWS = LENGTH - GRAM + 1  # 50-byte strings an anchor can stand for
_BEFORE = LENGTH - GRAM
_WIDTH = _BEFORE + LENGTH
_CHUNK_BYTES = 2 << 20
_SHARD_BYTES, _BUCKET_BYTES = 6 << 20, 8 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Chunk:
    """Some documents of a shard in one buffer, with their anchors."""

    def __init__(self, doc_ids: np.ndarray, texts: list[bytes]):
        self.doc_ids = doc_ids
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        n = len(self.data) - GRAM + 1
        if n <= 0:
            self.at, self.keys, self.owner = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        a, b, c = (np.ndarray((n,), "<u8", self.raw, offset=o, strides=(1,)) for o in (0, 8, 12))
        hashes = mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b * np.uint64(0xC2B2AE3D27D4EB4F) + c))
        for end in self.ends.tolist():  # 20-grams over the end of a document
            hashes[max(0, end - GRAM + 1):end] = _NONE
        wide = np.concatenate((hashes, np.full(_WINDOWS - 1, _NONE)))
        least = _sliding(wide, np.minimum)  # of the 31 20-grams from here on
        chosen = _sliding(np.concatenate((np.zeros(_WINDOWS - 1, np.uint64), least)), np.maximum) == hashes
        self.at = np.flatnonzero(chosen & (hashes != _NONE))
        self.keys = hashes[self.at]
        self.owner = np.searchsorted(self.ends, self.at, side="right")

    def surroundings(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Identity, bytes before, and bytes from the anchor on, of the picked anchors' surroundings; first byte."""
        at, owner = self.at[pick], self.owner[pick]
        first = np.maximum(at - _BEFORE, self.starts[owner])
        last = np.minimum(at + LENGTH, self.ends[owner])
        before, after = at - first, last - at
        whole = substring_hashes(prefix_sums(self.data), first, last)
        return mix(whole + (before * 128 + after).astype(np.uint64)), before, after, first

    def matrix(self, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """One row of 80 bytes for each anchor; bytes outside the document are 0."""
        columns = np.arange(-_BEFORE, LENGTH)
        index = at[:, None] + columns
        inside = (columns >= -before[:, None]) & (columns < after[:, None])
        return np.where(inside, self.data[np.clip(index, 0, len(self.data) - 1)], 0).astype(np.uint8)


def _sliding(values: np.ndarray, pick) -> np.ndarray:
    """Extreme of every 31 consecutive values."""
    for step in (1, 2, 4, 8):
        values = pick(values[:-step], values[step:])
    return pick(values[:-15], values[15:])


def _tag(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True)


def _copies(table: pa.Table) -> set[tuple[int, int]]:
    """(doc_id, tag) of the documents that are whole copies of an earlier one."""
    return {(d, t) for d, t in zip(table["doc_id"].to_pylist(), table["tag"].to_pylist()) if t is not None}


def _chunks(table: pa.Table, copies: set[tuple[int, int]]):
    """The documents of a shard that are no whole copies, some at a time."""
    doc_ids, texts, size = [], [], 0
    for batch in table.to_batches(max_chunksize=2000):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            if copies and (doc_id, _tag(data)) in copies:
                continue
            doc_ids.append(doc_id)
            texts.append(data)
            size += len(texts[-1])
            if size >= _CHUNK_BYTES:
                yield Chunk(np.array(doc_ids, np.int64), texts), texts
                doc_ids, texts, size = [], [], 0
    if texts:
        yield Chunk(np.array(doc_ids, np.int64), texts), texts


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, columns of its rows)."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield int(bucket[lo]), *(c[order[lo:hi]] for c in columns)


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_ASK = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("several", pa.binary())])
_SEND = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("identity", pa.binary()), ("keys", pa.binary()), ("reach", pa.binary()),
                   ("documents", pa.binary()), ("symbols", pa.binary())])
_TELL = pa.schema([("shard", pa.int32()), ("identity", pa.binary()), ("runs", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("least", pa.binary())])
_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def ask(table: pa.Table, copied: pa.Table, buckets: int) -> pa.Table:
    """The anchors of a shard, each once, with a mark where more than one of its documents has it."""
    if not table.num_rows:
        return _rows([], _ASK)
    keys, docs = [], []
    for chunk, _ in _chunks(table, _copies(copied)):
        keys.append(chunk.keys)
        docs.append(chunk.doc_ids[chunk.owner])
    if not keys:
        return _rows([], _ASK)
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return _rows([], _ASK)
    several = docs[at] != docs[np.concatenate((at[1:], [len(docs)])) - 1]
    shard = table["shard"][0].as_py()
    return _rows([{"bucket": b, "shard": shard, "keys": k.astype("<u4").tobytes(), "several": np.packbits(s).tobytes()}
                  for b, k, s in _by_bucket(_bucket(keys[at], buckets), keys[at] & np.uint64(0xFFFFFFFF), several)], _ASK)


def answer(table: pa.Table) -> pa.Table:
    """For every shard that asked a bucket: the anchors that more than one document has."""
    bucket, shards = table["bucket"][0].as_py(), table["shard"].to_pylist()
    keys = [np.frombuffer(k, "<u4") for k in table["keys"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(s, np.uint8))[: len(k)].astype(bool) for s, k in zip(table["several"].to_pylist(), keys)]
    both, index, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    repeated = count > 1
    repeated[index[np.concatenate(several)]] = True
    out = [{"shard": s, "bucket": bucket, "keys": k[r].tobytes()} for s, k, r in
           zip(shards, keys, np.split(repeated[index], np.cumsum([len(k) for k in keys])[:-1])) if r.any()]
    return _rows(out, pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary())]))


def send(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Distinct surroundings of the shard's repeated anchors."""
    copies, answers = _copies(answers), answers.filter(pc.is_valid(answers["bucket"]))
    if not docs.num_rows or not answers.num_rows:
        return _rows([], _SEND)
    shard = docs["shard"][0].as_py()
    wanted = np.unique(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, "<u4").astype(np.uint64)
                                       for b, k in zip(answers["bucket"].to_pylist(), answers["keys"].to_pylist())]))
    parts: list[tuple] = []
    for chunk, _ in _chunks(docs, copies):
        bucket = _bucket(chunk.keys, buckets)
        name = (bucket.astype(np.uint64) << np.uint64(32)) | (chunk.keys & np.uint64(0xFFFFFFFF))
        pick = np.flatnonzero(np.isin(name, wanted))
        if not len(pick):
            continue
        identity, before, after, _ = chunk.surroundings(pick)
        ids = chunk.doc_ids[chunk.owner[pick]]
        _, one, index = np.unique(identity, return_index=True, return_inverse=True)
        low = np.full(len(one), np.iinfo(np.int64).max)
        high = np.full(len(one), np.iinfo(np.int64).min)
        np.minimum.at(low, index, ids)
        np.maximum.at(high, index, ids)
        parts.append((identity[one], chunk.keys[pick][one], np.stack((before[one], after[one]), 1).astype(np.uint8),
                      np.stack((low, high), 1), chunk.matrix(chunk.at[pick][one], before[one], after[one])))
    if not parts:
        return _rows([], _SEND)
    identity, keys, reach, documents, symbols = (np.concatenate(c) for c in zip(*parts))
    _, one, index = np.unique(identity, return_index=True, return_inverse=True)
    low, high = documents[one, 0].copy(), documents[one, 1].copy()
    np.minimum.at(low, index, documents[:, 0])
    np.maximum.at(high, index, documents[:, 1])
    documents = np.stack((low, high), 1)
    return _rows([{"bucket": b, "shard": shard, "identity": i.tobytes(), "keys": k.tobytes(), "reach": r.tobytes(), "documents": d.tobytes(), "symbols": s.tobytes()}
                  for b, i, k, r, d, s in _by_bucket(_bucket(keys[one], buckets), identity[one], keys[one], reach[one], documents, symbols[one])], _SEND)


def first_documents(keys: np.ndarray, reach: np.ndarray, least: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """For every string and each of its 31 windows: the smallest document with that window (its own at most).

    Rows are strings of 80 symbols under one anchor key each; ``reach`` has the bytes inside the document
    before and from the anchor on. Windows over an end of the document get the largest integer.
    """
    n = len(keys)
    out = np.full((n, _WINDOWS), np.iinfo(np.int64).max)
    with tempfile.TemporaryFile() as columns:
        np.ascontiguousarray(symbols.T).tofile(columns)
        order = np.argsort(keys, kind="stable")
        group = np.cumsum(np.concatenate(([0], (keys[order][1:] != keys[order][:-1]).astype(np.int64))))
        common = np.full(n, _WIDTH, np.int32)  # prefix shared with the neighbour before, from this column on
        common[np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))] = -1  # never across groups
        common[common >= 0] = 0
        for column in range(_WIDTH - 1, -1, -1):
            columns.seek(column * n)
            symbol = np.fromfile(columns, np.uint8, n)[order].astype(np.int64)
            outside = (column < _BEFORE - reach[order, 0]) | (column >= _BEFORE + reach[order, 1])
            symbol[outside] = 256
            place = np.argsort(group * 512 + symbol, kind="stable")
            moved, at = symbol[place], place
            grown = np.empty(n, np.int32)
            grown[0] = -1
            same = (group[1:] == group[:-1]) & (moved[1:] == moved[:-1])
            left, right = at[:-1], at[1:]
            close = same & (right == left + 1)
            grown[1:] = np.where(group[1:] != group[:-1], -1, 0)
            grown[1:][close] = common[right[close]] + 1
            far = np.flatnonzero(same & ~close)
            if len(far):
                ends = np.stack((left[far] + 1, right[far] + 1), 1).ravel()
                grown[1:][far] = np.minimum.reduceat(np.append(common, np.int32(_WIDTH)), ends)[::2] + 1
            order, common = order[place], grown
            if column < _WINDOWS:
                ok = (reach[order, 0] >= _BEFORE - column) & (reach[order, 1] >= LENGTH - _BEFORE + column)
                heads = np.flatnonzero(common < LENGTH)
                smallest = np.minimum.reduceat(least[order], heads)
                found = np.repeat(smallest, np.diff(np.append(heads, n)))
                out[order[ok], column] = found[ok]
    return out


def tell(table: pa.Table) -> pa.Table:
    """For every shard of a bucket: its surroundings with windows that a smaller document has."""
    parts = [(np.frombuffer(i, np.uint64), np.frombuffer(k, np.uint64), np.frombuffer(r, np.uint8).reshape(-1, 2), np.frombuffer(d, np.int64).reshape(-1, 2),
              np.frombuffer(s, np.uint8).reshape(-1, _WIDTH)) for i, k, r, d, s in zip(*(table[c].to_pylist() for c in ("identity", "keys", "reach", "documents", "symbols")))]
    shards = table["shard"].to_pylist()
    identity, keys, reach, documents, symbols = (np.concatenate(c) for c in zip(*parts))
    # equal bytes, not equal hashes, make one string
    whole = np.concatenate((symbols, reach), axis=1)
    _, one, index = np.unique(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, index, documents[:, 0])
    first = first_documents(keys[one], reach[one].astype(np.int64), least, symbols[one])[index]
    sender = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    used = np.flatnonzero((first < documents[:, 1:2]).any(axis=1))
    out = []
    for s, some in _by_bucket(sender[used], used):
        table_ = first[some]
        change = np.ones(table_.shape, bool)
        change[:, 1:] = table_[:, 1:] != table_[:, :-1]
        row, begin = np.nonzero(change)
        stop = np.append(begin[1:], 0)
        stop[np.append(row[1:] != row[:-1], True)] = _WINDOWS
        out.append({"shard": shards[s], "identity": identity[some].tobytes(), "runs": change.sum(axis=1).astype(np.uint8).tobytes(),
                    "first": begin.astype(np.uint8).tobytes(), "last": (stop - 1).astype(np.uint8).tobytes(), "least": table_[row, begin].tobytes()})
    return _rows(out, _TELL)


def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Size, removed bytes and runs, and digest of what is left, for every document of a shard."""
    out: list[dict] = []
    copies, told = _copies(told), told.filter(pc.is_valid(told["identity"]))
    if copies:
        for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            if (doc_id, _tag(data)) in copies:
                out.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": len(data), "n_spans": 1, "kept_sha256": hashlib.sha256().hexdigest()})
    identity = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in told["identity"].to_pylist()]])
    runs = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(x, np.uint8) for x in told["runs"].to_pylist()]]).astype(np.int64)
    first, last = (np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(x, np.uint8) for x in told[c].to_pylist()]]).astype(np.int64) for c in ("first", "last"))
    least = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, np.int64) for x in told["least"].to_pylist()]])
    begin = np.cumsum(runs) - runs
    order = np.argsort(identity, kind="stable")
    identity, runs, begin = identity[order], runs[order], begin[order]
    for chunk, texts in _chunks(docs, copies):
        depth = np.zeros(len(chunk.data) + 1, np.int32)
        if len(identity) and len(chunk.at):
            own, _, _, _ = chunk.surroundings(np.arange(len(chunk.at)))
            place = np.minimum(np.searchsorted(identity, own), len(identity) - 1)
            hit = np.flatnonzero(identity[place] == own)
            many = runs[place[hit]]
            anchor = np.repeat(hit, many)
            run = np.repeat(begin[place[hit]] - np.cumsum(many) + many, many) + np.arange(len(anchor))
            earlier = least[run] < chunk.doc_ids[chunk.owner[anchor]]
            anchor, run = anchor[earlier], run[earlier]
            np.add.at(depth, chunk.at[anchor] - _BEFORE + first[run], 1)
            np.add.at(depth, chunk.at[anchor] - _BEFORE + last[run] + LENGTH, -1)
        gone = np.cumsum(depth[:-1]) > 0
        edge = np.diff(gone.astype(np.int8), prepend=0) == 1
        if len(chunk.data):
            starts = chunk.starts[chunk.starts < len(gone)]
            edge[starts] = gone[starts]  # runs end with the document
        removed, opened = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(edge)))
        for doc_id, text, lo, hi in zip(chunk.doc_ids.tolist(), texts, chunk.starts.tolist(), chunk.ends.tolist()):
            lost = int(removed[hi] - removed[lo])
            left = chunk.data[lo:hi][~gone[lo:hi]].tobytes() if lost else text
            out.append({"doc_id": doc_id, "n_bytes": hi - lo, "n_removed": lost, "n_spans": int(opened[hi] - opened[lo]),
                        "kept_sha256": hashlib.sha256(left).hexdigest()})
    return _rows(out, _CUT)


def whole_copies(texts: DataFrame) -> DataFrame:
    """(doc_id, tag) of the rows whose text, of 50 bytes or more, a smaller document has whole."""
    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([hashlib.sha256(r).digest() for r in rows], pa.binary()), pa.array([_tag(r) for r in rows], pa.int64())], ["doc_id", "digest", "tag"])

    long = texts.where(F.octet_length("text") >= LENGTH)
    rows = map_batches(long.select("doc_id", "text"), digest, "doc_id long, digest binary, tag long")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return rows.join(first, "digest").where("doc_id > first").select("doc_id", "tag").distinct()


@contextlib.contextmanager
def _shuffles_end_with_their_job(spark):
    """Shuffle files of each step go when its table is written, so the steps' disk needs do not add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    shards, buckets = partitions_for(docs, _SHARD_BYTES), partitions_for(docs, _BUCKET_BYTES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    named = texts.where("doc_id IS NOT NULL").withColumn("shard", shard)
    with _shuffles_end_with_their_job(docs.sparkSession):
        copies = materialize(whole_copies(texts.where("doc_id IS NOT NULL")).withColumn("shard", shard))
        asked = materialize(named.groupBy("shard").cogroup(copies.groupBy("shard")).applyInArrow(
            lambda d, c: ask(d, c, buckets), "bucket int, shard int, keys binary, several binary"))
        answers = materialize(asked.groupBy("bucket").applyInArrow(answer, "shard int, bucket int, keys binary"))
        replies = answers.unionByName(copies, allowMissingColumns=True)
        sent = named.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(
            lambda d, a: send(d, a, buckets), "bucket int, shard int, identity binary, keys binary, reach binary, documents binary, symbols binary")
        told = materialize(sent.groupBy("bucket").applyInArrow(
            tell, "shard int, identity binary, runs binary, first binary, last binary, least binary"))
    replies = told.unionByName(copies, allowMissingColumns=True)
    result = named.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    nameless = texts.where("doc_id IS NULL").select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                                    F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    return result.unionByName(nameless)
