"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is merged on its own. Its parts form a linked list; every adjacent pair whose bytes
have a rank waits in the bucket of that rank. A bitmap with a summary level over the ranks finds
the lowest waiting rank with two find-first-set steps, so a pre-token of n bytes costs O(n) queue
steps however long it is. Entries whose pair has changed meanwhile are stale and skipped.

Null and empty texts have no tokens. Rows are independent: repeated rows give equal results,
empty tables give none, further columns are ignored. The ranks (a vocabulary file, 50,000 entries)
are broadcast; the number of entries is checked against ``MAX_RANKS``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerlens.llm.frames import map_batches

MAX_RANKS = 1 << 20
KEPT_CHUNKS = 150_000  # before a batch; a batch adds its own
AT_ONCE = 6_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and one rank a line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{len(ranks)} ranks; at most {MAX_RANKS} are broadcast")
    return ranks


class RankQueue:
    """Waiting positions by rank. The bitmap has a bit for each rank with a non-empty bucket, 256 to a
    word, and ``merge`` keeps a summary of the words in use; all are empty again after each merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values(), default=0) + 1
        self.buckets: list[list[int]] = [[] for _ in range(top)]
        self.words = [0] * ((top >> 8) + 1)
        self.bits = [1 << i for i in range(max(256, len(self.words)))]

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        get, buckets, words, bits = self.ranks.get, self.buckets, self.words, self.bits
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        summary = 0
        for i in range(n - 1):
            rank = get(piece[i:i + 2])
            if rank is not None:
                pair[i] = rank
                waiting = buckets[rank]
                if not waiting:
                    words[rank >> 8] |= bits[rank & 255]
                    summary |= bits[rank >> 8]
                waiting.append(i)
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            waiting = buckets[rank]
            i = heappop(waiting)
            if not waiting:
                word &= word - 1
                words[high] = word
                if not word:
                    summary &= summary - 1
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = pair[i] = -1
            if end < n:
                before[end] = i
                rank = get(piece[i:after[end]])
                if rank is not None:
                    pair[i] = rank
                    waiting = buckets[rank]
                    if not waiting:
                        words[rank >> 8] |= bits[rank & 255]
                        summary |= bits[rank >> 8]
                    heappush(waiting, i)
            left = before[i]
            if left >= 0:
                rank = get(piece[left:end])
                if rank is None:
                    pair[left] = -1
                elif pair[left] != rank:
                    pair[left] = rank
                    waiting = buckets[rank]
                    if not waiting:
                        words[rank >> 8] |= bits[rank & 255]
                        summary |= bits[rank >> 8]
                    heappush(waiting, left)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out


class BatchMerger:
    """The same queue over many pre-tokens laid end to end: a bucket holds the positions of one rank in all
    of them, and each step merges a whole bucket with array operations.

    That equals merging the leftmost lowest pair again and again unless a merge makes a pair of lower
    rank than its own; pre-tokens where this happens are done again one merge at a time.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.single = RankQueue(ranks)
        top = max(ranks.values(), default=0) + 1
        pairs = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank))
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.rank_of = np.array([r for _, r in pairs] + [-1], np.int32)
        self.byte_id = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.words = [0] * ((top >> 8) + 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece, as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if not n:
            return [b""] * len(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate(([0], ends[:-1]))
        ids = self.byte_id[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        last = np.zeros(n, bool)
        last[ends[ends > starts] - 1] = True
        before[starts[ends > starts]] = -1
        pair = np.full(n, -1, np.int32)
        inner = np.flatnonzero(~last)
        pair[inner] = self.lookup(ids[inner], ids[inner + 1])
        live, again = np.ones(n, bool), []
        buckets: dict[int, list[np.ndarray]] = {}
        words, summary = self.words, 0

        def push(at: np.ndarray, rank: np.ndarray) -> int:
            """Add positions to the buckets of their ranks; the bits of the bitmap words now in use."""
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            used = 0
            for r, lo, hi in zip(rank[bounds[:-1]].tolist(), bounds, bounds[1:]):
                if r in buckets:
                    buckets[r].append(at[lo:hi])
                else:
                    buckets[r] = [at[lo:hi]]
                    words[r >> 8] |= 1 << (r & 255)
                    used |= 1 << (r >> 8)
            return used

        waiting = np.flatnonzero(pair >= 0)
        if len(waiting):
            summary = push(waiting, pair[waiting])
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            words[high] = word & (word - 1)
            if not words[high]:
                summary &= summary - 1
            parts = buckets.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            gone = after[at]
            if len(at) > 1 and (clash := at[1:] == gone[:-1]).any():
                place = np.arange(len(at))
                first = np.where(np.concatenate(([True], ~clash)), place, 0)
                keep = (place - np.maximum.accumulate(first)) % 2 == 0
                at, gone = at[keep], gone[keep]
            ids[at] = rank
            after[at] = after[gone]
            last[at] = last[gone]
            live[gone] = False
            pair[gone] = -1
            pair[at] = -1
            right = at[~last[at]]
            before[after[right]] = right
            left = before[at]
            left = left[left >= 0]
            ahead = self.lookup(ids[right], ids[after[right]])
            behind = self.lookup(ids[left], ids[after[left]])
            pair[right], pair[left] = ahead, behind
            new, ranks = np.concatenate((right, left)), np.concatenate((ahead, behind))
            ok = ranks >= 0
            if ok.any():
                new, ranks = new[ok], ranks[ok]
                if (lower := ranks < rank).any():
                    again.append(new[lower])
                summary |= push(new, ranks)
        kept = np.flatnonzero(live)
        tokens = ids[kept].astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(kept, np.concatenate(([0], ends)))).tolist()
        out = [tokens[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
        if again:
            for k in np.unique(np.searchsorted(ends, np.concatenate(again), side="right")).tolist():
                out[k] = np.array(self.single.merge(pieces[k]), "<u4").tobytes()
        return out


class Codec:
    """Encoder and decoder of whole texts; remembers a bounded number of space-led chunks.

    ``pattern`` must cut before every single space that stands between two other characters, as
    byte-level patterns do; texts without wider white space around a space are looked up by such chunks,
    and only new chunks are split by the pattern and merged, all of a batch together.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.wide = re.compile(r"\s | \s").search
        self.merger = BatchMerger(ranks) if pattern else None
        self.kept: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """Pieces whose ids can be joined: space-led chunks, or the whole text where spaces meet other white space."""
        if self.wide(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers; about ``AT_ONCE`` characters at a time."""
        out: list[bytes] = []
        lo = size = 0
        for hi, text in enumerate(texts, start=1):
            size += len(text or "")
            if size >= AT_ONCE or hi == len(texts):
                out += self._encode(texts[lo:hi])
                lo, size = hi, 0
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.kept) > KEPT_CHUNKS:
            self.kept = {}
        known = self.kept
        new: set[str] = set()
        for text in texts:
            if text:
                new.update([c for c in self.cut(text) if c not in known])
        if new:
            split = {c: [p.encode() for p in self.split(c)] for c in new}
            pieces = list({p for parts in split.values() for p in parts})
            whole = self.ranks.get
            done = {p: int.to_bytes(r, 4, "little") for p in pieces if (r := whole(p)) is not None}
            rest = [p for p in pieces if p not in done]
            done.update(zip(rest, self.merger.merge(rest)))
            for c, parts in split.items():
                known[c] = b"".join([done[p] for p in parts])
        return [b"".join([known[c] for c in self.cut(text)]) if text else b"" for text in texts]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a text from its ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path_key: str, shared, pattern: str) -> Codec:
    """One codec for each vocabulary and pattern in a worker process, kept between its tasks."""
    if (path_key, pattern) not in _codecs:
        _codecs.clear()
        _codecs[path_key, pattern] = Codec(shared.value, pattern)
    return _codecs[path_key, pattern]


def _forget() -> None:
    """Drop the chunks that this worker's codecs remember."""
    for codec in _codecs.values():
        codec.kept = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): the token ids of every whole text, as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(ranks_path, shared, pattern)
        ids = codec.encode(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    out = map_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")), run, f"key {docs.schema[key].dataType.simpleString()}, ids binary", _forget)
    return out.withColumnRenamed("key", key)


def decode(tokens: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """(key, bytes): the decoded bytes of ``ids``."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(ranks_path, shared, "")
        found = [codec.decode(i or b"") for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["key", "bytes"])

    out = map_batches(tokens.select(tokens[key].alias("key"), "ids"), run, f"key {tokens.schema[key].dataType.simpleString()}, bytes binary")
    return out.withColumnRenamed("key", key)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one encode and one decode of every whole text in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(ranks_path, shared, pattern)
        counts, ids_hex, text_hex = [], [], []
        for ids in codec.encode(batch.column(1).to_pylist()):
            counts.append(len(ids) // 4)
            ids_hex.append(hashlib.sha256(ids).hexdigest())
            text_hex.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    columns = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return map_batches(columns, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _forget)
