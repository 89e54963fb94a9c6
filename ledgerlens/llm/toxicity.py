"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters, digits and non-ASCII bytes, ASCII lower-cased. The features of a
text are the distinct hashes of its words, word pairs, and pairs with one word between.
A word also counts by its stems (its first 4
and 5 bytes), so inflected forms that no labelled row holds are known by their stem. Training visits a bounded sample of labelled rows one by one (``SAMPLE_ROWS``, taken by hash of the
id, in hash order); per-coordinate rates and L1 leave few weights, which are broadcast (their number
is bounded by ``SAMPLE_ROWS`` and by ``2**BITS``). Scoring is one pass over all whole texts.

Null, empty and wordless texts score the intercept. Repeated label rows of one id count once, as
toxic if one of them is; rows with a null id or null label are not learnt from. Without labelled
rows every score is 0.5. Repeated documents are scored alike; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import hashing
from ledgerlens.llm.frames import map_batches

BITS = 22
SAMPLE_ROWS = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
WEIGHT = 2.0  # of a toxic row
THRESHOLD = 0.7
STEMS = (4, 5)
_BIAS = np.uint64(0)

_ALPHABET = np.zeros(256, np.uint8)
_ALPHABET[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_ALPHABET[65:91] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(text: str | None) -> np.ndarray:
    """Hashes of all words, pairs and skip-pairs in order of kind; the intercept first."""
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    edge = np.diff(_ALPHABET[data], prepend=0, append=0).astype(np.int8) if len(data) else np.empty(0, np.int8)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.array([_BIAS])
    sums = hashing.prefix_sums(data)
    word = hashing.substring_hashes(sums, start, end)
    second = word * np.uint64(0x9FB21C651E98DF25)
    kinds = [word] + [hashing.mix(word[:-k] + second[k:] + np.uint64(k)) for k in (1, 2) if len(word) > k]
    for k in STEMS:
        long = end - start > k
        kinds.append(hashing.mix(hashing.substring_hashes(sums, start[long], start[long] + k) + np.uint64(k)))
    out = np.concatenate(kinds) >> np.uint64(64 - BITS)
    return np.concatenate(([_BIAS], out))


def train(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights after ``EPOCHS`` passes over (label, distinct feature indices)."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)

    def weight(i: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for label, i in rows:
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (WEIGHT if label else 1.0)
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    kept = np.flatnonzero(np.abs(z) > L1)
    return kept, weight(kept)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from rows of ``labels`` (doc_id, toxic) whose crc32(doc_id) mod 3 is not 1."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    share = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    place = F.xxhash64("doc_id", F.lit(7))
    limit = int(share * 2.0 ** 64) - 2 ** 63
    sample = known.where(place <= min(limit, 2 ** 63 - 1)).withColumn("place", place)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(features(t)).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["place", "toxic", "features"])

    def learn(batches):
        found = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
        found.sort(key=lambda row: row[:2])
        at, weights = train([(y, np.frombuffer(f, "<u4").astype(np.int64)) for _, y, f in found])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights)], ["at", "weight"])

    rows = map_batches(sample.join(texts, "doc_id").select("place", "toxic", "text"), index, "place long, toxic int, features binary")
    learnt = rows.repartition(1).mapInArrow(learn, "at long, weight double").toArrow()  # bounded: the sample
    return learnt["at"].to_numpy(), learnt["weight"].to_numpy()


def held_out(column: str):
    """Whether the id belongs to the third never learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def _table(weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    table = np.zeros(1 << BITS, np.float32)
    table[weights[0]] = weights[1]
    return table


def _score(table: np.ndarray, text: str | None) -> float:
    f = features(text)
    f = np.unique(f[table[f] != 0])
    return 1 / (1 + np.exp(-np.clip(float(table[f].sum()), -35, 35)))


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept: dict[str, np.ndarray] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = kept["w"] if kept else kept.setdefault("w", _table(shared.value))
        out = [_score(table, t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that score below ``THRESHOLD``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")
    kept: dict[str, np.ndarray] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = kept["w"] if kept else kept.setdefault("w", _table(shared.value))
        clean = [_score(table, t) < THRESHOLD for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array(clean))

    return map_batches(docs, run, docs.schema)
