"""Target-distribution importance resampling of documents over hashed word n-grams.

1. One pass over the texts by Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
   ``dictionary_encode`` turn a batch into dictionary indices; an index and the next one of the same text
   form a pair; every distinct word and every distinct pair of the batch is hashed once (CRC-32) and ``take``
   gives each feature its bucket. The buckets of each document are written, two bytes a feature.
2. The buckets of all documents and of all target texts are counted; each task adds up its own counts
   first, so a task sends ``buckets`` rows at most. The gains, one number a bucket, are all that is broadcast.
3. The gains of a document's features are taken and summed by segments; noise from the document's own
   hash makes the highest scores a weighted draw without replacement, repeatable and free of partitioning.
4. Ranks come from a range-partitioned sort of (score, doc_id), not from one task.

Null and empty texts have no features and weight 0. All rows count in the totals. Rows with a null doc_id have
no score and are never drawn, nor do they count among the documents to draw from. Rows that share a doc_id
are separate documents; between equal scores the smaller doc_id, then the larger weight, is drawn first.
A word may have any length. Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.order import global_row_number
from ledgerlens.llm.frames import map_batches, materialize
from ledgerlens.llm.terms import dictionary_terms

BUCKETS = 10_000


def feature_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features text by text, features of every text, words of every text).

    The features of a text are its words followed by its pairs of neighbouring words.
    """
    terms, index, words = dictionary_terms(texts)
    spelled = terms.cast(pa.binary()).to_pylist()
    crc = list(map(zlib.crc32, spelled))
    ends = np.cumsum(words)
    inner = np.ones(len(index), bool)  # words with a next word in their text
    inner[ends[words > 0] - 1] = False
    first = np.flatnonzero(inner)
    pairs = pc.dictionary_encode(pa.array(index[first] * len(spelled) + index[first + 1]))
    code = pairs.dictionary.to_numpy()
    left, right = np.divmod(code, max(1, len(spelled)))
    after = [b" " + word for word in spelled]
    # the checksum of "left right" goes on from that of left
    pair_crc = list(map(zlib.crc32, map(after.__getitem__, right.tolist()), map(crc.__getitem__, left.tolist())))
    word_bucket = pc.take(pa.array(np.array(crc, np.int64) % buckets), pa.array(index)).to_numpy()
    pair_bucket = pc.take(pa.array(np.array(pair_crc, np.int64) % buckets), pairs.indices).to_numpy()
    n_pairs = np.maximum(words - 1, 0)
    sizes = words + n_pairs
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    out[np.arange(len(index)) + np.repeat(starts - (ends - words), words)] = word_bucket
    out[np.arange(len(first)) + np.repeat(starts + words - (np.cumsum(n_pairs) - n_pairs), n_pairs)] = pair_bucket
    return out, sizes, words


def features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the buckets as little-endian 16-bit (32-bit above 65,536 buckets) integers."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes, words = feature_buckets(batch.column(1), buckets)
        offsets = np.concatenate(([0], np.cumsum(sizes))) * kind.itemsize
        packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [
            None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.astype(kind))])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words), pa.array(sizes), packed.cast(pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, "doc_id long, n_words long, n_features long, buckets binary")


def _flat(column: pa.Array, buckets: int) -> np.ndarray:
    """All bucket numbers of a batch of ``features``."""
    if not len(column):
        return np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]].view("<u2" if buckets <= 1 << 16 else "<u4").astype(np.int64)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    summed = found.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed target to source frequency) of each bucket."""
    n = len(source)
    ratio = (target + 1.0) * (float(source.sum()) + n) / ((source + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256 of ``seed:doc_id``."""
    digits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((digits + 0.5) / 4294967296.0))).cast("long")


def weigh(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): floored mean gain of each row of ``features``."""
    buckets = len(gains)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = batch.column(2).to_numpy()
        each = pc.take(pa.array(gains), pa.array(_flat(batch.column(3), buckets))).to_numpy()
        upto = np.concatenate(([0], np.cumsum(each)))
        ends = np.cumsum(sizes)
        weight = np.floor_divide(upto[ends] - upto[ends - sizes], np.maximum(sizes, 1))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return map_batches(found, run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    Of the documents with ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn.
    """
    found = materialize(features(docs, buckets))
    wanted = features(target.select(F.lit(0).alias("doc_id"), "text"), buckets)
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    scored = materialize(weigh(found, gains).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)))
    allowed = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    quota = scored.where(allowed).select(F.expr(f"count(*) * {int(percent)} div 100")).scalar()
    ranked = global_row_number(scored.where(allowed), [F.desc("score"), "doc_id", F.desc("weight"), "n_features"], "place")
    drawn = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= quota, F.col("place")).alias("rank"))
    rest = scored.where(~allowed).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.union(rest)


# CRC-32 of the distinct features is a fold over their bytes; its table follows from the polynomial.
SQL = r"""
WITH crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i))
), texts AS (
    SELECT 's' AS side, row_number() OVER () AS no, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), words AS (
    SELECT side, no, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM texts
), items AS (
    SELECT side, no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), counted AS (
    SELECT side, no, f, count(*) AS n FROM items GROUP BY ALL
), hashed AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)), crc_table
), totals AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
    FROM counted JOIN hashed USING (f) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000) / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000))))::BIGINT AS gain
    FROM totals
), summed AS (
    SELECT no, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
    FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 's' GROUP BY no
), scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN summed USING (no) WHERE side = 's'
), ranked AS (
    SELECT doc_id, n_words, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""
