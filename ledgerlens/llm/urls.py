"""URL filter: rules by host and path, then a listed set behind a blocked Bloom filter.

Canonical form of a URL for the list: host without a leading ``www.`` or ``m.``, then the path without
trailing slashes and without ``.html``; scheme, query and fragment do not count.

The filter is an array of 512-bit blocks; a URL's hash picks one block and sets ``PROBES`` bits in it, so
a test touches one block. Its size is fixed (``FILTER_BYTES``), and so is the broadcast. A longer list
only raises the share of false hits, and every hit goes on to an exact join, which removes them; so the
verdict does not depend on the filter. Blocks are built in parallel and merged by block.

Null urls and urls without ``://`` have an empty host and path, match no rule, are on no list and are
allowed. Null and empty list entries are ignored, repeated ones count once. Repeated page rows are
judged alike; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import map_batches

# The rules (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Host labels whose pages the registered query lists.
LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
FILTER_BYTES = 1 << 22
PROBES = 8
_BLOCK_BITS = 512
_BLOCKS = FILTER_BYTES * 8 // _BLOCK_BITS


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    has = F.coalesce(at > 0, F.lit(False))
    return F.when(has, F.translate(host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """Key of a url in the list; null for urls without host."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html$", "")))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of every hash, and its bits in the block as an array of ``PROBES`` columns."""
    h = hashes.view(np.uint64)
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(9)
    shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(6)
    bits = ((step[:, None] >> shifts) & np.uint64(63)) + np.uint64(64) * np.arange(PROBES, dtype=np.uint64)
    return (h % np.uint64(_BLOCKS)).astype(np.int64), bits.astype(np.int64)


def bloom(keys: DataFrame) -> np.ndarray:
    """The filter of the column ``key``: uint64 words, eight to a block."""
    def partial(batches):
        words = np.zeros(_BLOCKS * 8, np.uint64)
        for batch in batches:
            block, bits = _probes(batch.column(0).to_numpy())
            np.bitwise_or.at(words, (block[:, None] * 8 + bits // 64).ravel(), np.uint64(1) << (bits % 64).astype(np.uint64).ravel())
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], ["word", "bits"])

    hashes = keys.where("key IS NOT NULL AND key <> ''").select(F.xxhash64("key").alias("hash")).distinct()
    merged = hashes.mapInArrow(partial, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(_BLOCKS * 8, np.uint64)
    out[merged["word"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return out


def possible(pages: DataFrame, words: np.ndarray) -> DataFrame:
    """``pages`` (page_id, host, path, key) with the column ``maybe``: whether the filter may hold the key."""
    shared = pages.sparkSession.sparkContext.broadcast(words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, bits = _probes(batch.column(batch.num_columns - 1).to_numpy())
        found = (shared.value[block[:, None] * 8 + bits // 64] >> (bits % 64).astype(np.uint64)) & np.uint64(1)
        hit = pa.array(found.all(axis=1))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], hit], ["page_id", "host", "path", "key", "maybe"])

    return map_batches(pages.select("page_id", "host", "path", "key", F.xxhash64("key").alias("hash")), run,
                       "page_id long, host string, path string, key string, maybe boolean")


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every page; ``listed`` has blocked canonical urls as ``key``."""
    host, path = split_url(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("key", canonical(F.col("host"), F.col("path")))
    tested = possible(parts, bloom(listed))
    # only possible hits carry a join key; the others stay where they are
    exact = listed.where("key IS NOT NULL AND key <> ''").select(F.col("key").alias("listed_key")).distinct()
    hits = tested.where("maybe").join(exact, F.col("key") == F.col("listed_key"), "left")
    both = hits.union(tested.where("NOT maybe").withColumn("listed_key", F.lit(None).cast("string")))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    method = F.when(F.col("listed_key").isNotNull(), "block").otherwise("allow")
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def listing(pages: DataFrame) -> DataFrame:
    """The list that the registered query blocks: canonical urls of pages on a host with a label of ``LABELS``."""
    host, path = split_url(F.col("url"))
    return (pages.select(host.alias("host"), canonical(host, path).alias("key"))
            .where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, LABELS)))).select("key").distinct())


SQL = r"""
WITH parts AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM parts
), keyed AS (
    SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
        || regexp_replace(regexp_replace(path, '/+$', ''), '\.html$', '') END AS key FROM split
), listed AS (
    SELECT DISTINCT key FROM keyed WHERE list_has_any(string_split(host, '.'),
        ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
), rules(verdict, host, path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
    SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM keyed k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path) GROUP BY page_id
)
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN fits f USING (page_id) LEFT JOIN listed l ON k.key = l.key
"""
