"""Token ids in a compact file format: canonical length-limited Huffman codes in independent blocks.

A file set is a folder of Parquet files, so any store Spark can reach will do, and a lost executor's
part is written again by Spark's commit protocol. ``codes`` holds one row (symbols, lengths); ``blocks``
one row a block: part and number, tokens before it in its part, its documents (ids and lengths),
the bit offset of every ``CHECKPOINT``-th token, and the code bits. Blocks hold whole documents
in ascending doc_id order, at least ``BLOCK_TOKENS`` tokens but for the last of a part; a part is a
range of doc_ids. Code lengths come from the counts of all ids of all documents and are at most
``MAX_BITS``, so one table of 2**MAX_BITS entries decodes a code a look-up; runs between
checkpoints are decoded side by side.

Null and empty texts have the end id alone. Rows with a null doc_id come first; rows that share a doc_id
follow one another in the order of their ids. An empty table gives an empty file set. Further columns
are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.frames import BATCH_BYTES, partitions_for

MAX_BITS = 18
BLOCK_TOKENS = 1 << 16
CHECKPOINT = 256
KEPT_CHUNKS = 1_200_000  # of a worker process, up to twice that for a time: at most about 100 MB
JOINED = 1000  # unknown chunks that make one text for the library
HELD_BYTES = 20_000_000  # of texts whose chunks are told apart together
_PART_BYTES = 32 << 20
_SPACE = "[" + "".join(f"\\x{{{c:x}}}" for c in range(sys.maxunicode + 1) if chr(c).isspace()) + "]"
_CUT = re.compile(r"(?<=\S) (?=\S)").split


# --- ids -------------------------------------------------------------------------------------------

class Encoder:
    """Ids of whole texts from the tokenizers library, remembering space-led chunks between texts.

    A byte-level tokenizer cuts before every single space between two other characters, so such
    chunks can be encoded apart; wider white space stays inside a chunk. Chunks are told apart, looked up and put
    together as Arrow arrays; unknown ones go to the library many at a time, joined by the space that leads each, and the
    byte lengths of the tokens tell where each ends. Added tokens of the description that a text spells out, such as the
    end of text, get their own id, as in a plain call.
    """

    def __init__(self, description: str, dtype: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_str(description), dtype
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # of a token; a letter of its name is a byte
        for token, i in vocabulary.items():
            self.bytes[i] = added.get(i, len(token))
        self.end = pa.array([np.array([end_id], dtype).tobytes()], pa.binary())
        self.forget()

    def forget(self) -> None:
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of every text and the end id, as little-endian integers of the encoder's type."""
        filled = pc.fill_null(pc.not_equal(texts, ""), False)
        if not pc.all(filled).as_py():
            places = np.cumsum(filled.to_numpy(zero_copy_only=False)) * filled.to_numpy(zero_copy_only=False)
            return pa.concat_arrays([self.end, self._encode(texts.filter(filled))]).take(pa.array(places))
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern(texts, " ")
        offsets, chunks = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        code = chunks.indices.to_numpy()
        starts, ends = (pc.match_substring_regex(chunks.dictionary, form).to_numpy(zero_copy_only=False)[code] for form in (f"^({_SPACE}|$)", f"({_SPACE}|^)$"))
        loose = np.zeros(len(code) + 1, bool)  # places where the space before a chunk is not the only one
        loose[1:-1] = starts[1:] | ends[:-1]
        loose[offsets] = False
        wide = np.unique(np.searchsorted(offsets, np.flatnonzero(loose), side="right") - 1)
        if not len(wide):
            return self._joined(offsets, chunks)
        cut = [_CUT(t) for t in texts.take(pa.array(wide)).to_pylist()]
        whole = np.setdiff1d(np.arange(len(texts)), wide)
        own = pa.array([c for t in cut for c in t], pa.string()).dictionary_encode()
        parts = [self._joined(np.concatenate(([0], np.cumsum([len(t) for t in cut]))), own)]
        if len(whole):
            rest = pc.split_pattern(texts.take(pa.array(whole)), " ")
            parts.append(self._joined(rest.offsets.to_numpy(), rest.flatten().dictionary_encode()))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate((wide, whole)), kind="stable")))

    def _joined(self, offsets: np.ndarray, chunks: pa.DictionaryArray) -> pa.Array:
        """Ids of texts given as chunks; the first of a text has no space before it."""
        offsets = offsets - offsets[0]
        first = chunks.take(pa.array(offsets[:-1])).dictionary_decode().dictionary_encode()
        places = self._places(chunks.dictionary)[chunks.indices.to_numpy()]
        places[offsets[:-1]] = len(self.ids) + first.indices.to_numpy()
        table = pa.concat_arrays([self.ids, self._apart(first.dictionary.to_pylist()), self.end])
        taken = table.take(pa.array(np.insert(places, offsets[1:], len(table) - 1)))
        at = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:][offsets + np.arange(len(offsets))]
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), taken.buffers()[2]])

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Places of space-led chunks in ``ids``; those not known are encoded and remembered."""
        if len(self.known) > 2 * KEPT_CHUNKS:  # the first ones are the most frequent
            self.known, self.ids = self.known.slice(0, KEPT_CHUNKS), self.ids.slice(0, KEPT_CHUNKS)
        found = pc.index_in(chunks, value_set=self.known)
        if len(self.known) > KEPT_CHUNKS and found.null_count * 2 > len(chunks):  # other texts than before
            self.forget()
            found = pc.index_in(chunks, value_set=self.known)
        unknown = pc.is_null(found)
        new = chunks.filter(unknown)
        places = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        places[unknown.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        if len(new):
            self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, self._led(new)])
        return places

    def _led(self, chunks: pa.Array) -> pa.Array:
        """Ids of chunks with a space before each."""
        closed = pc.invert(pc.match_substring_regex(chunks, f"^({_SPACE}|$)|({_SPACE}|^)$"))
        run, parts, sizes = chunks.filter(closed), [], []
        if len(run):
            cuts = np.append(np.arange(0, len(run), JOINED), len(run))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), run), " ").to_pylist()
            for text, found in zip(texts, self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)):
                parts.append(np.array(found.ids, self.dtype))
        ids = np.concatenate(parts) if parts else np.empty(0, self.dtype)
        wanted = np.cumsum(pc.binary_length(run).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        reached = np.cumsum(self.bytes[ids])
        ends = np.searchsorted(reached, wanted) + 1
        if len(run) and (reached[-1] != wanted[-1] or not np.array_equal(reached[ends - 1], wanted)):
            return self._apart([" " + c for c in chunks.to_pylist()])  # tokens do not stand for their bytes
        sizes = np.concatenate(([0], ends)) * ids.itemsize
        made = pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
        if len(run) == len(chunks):
            return made
        others = self._apart([" " + c for c in chunks.filter(pc.invert(closed)).to_pylist()])
        kept = closed.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([made, others]).take(pa.array(np.where(kept, np.cumsum(kept) - 1, len(made) + np.cumsum(~kept) - 1)))

    def _apart(self, texts: list[str]) -> pa.Array:
        """Ids of every text by itself."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return pa.array([np.array(f.ids, self.dtype).tobytes() for f in found], pa.binary())


_encoders: dict[tuple[str, int], Encoder] = {}


def _dtype(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


def encode(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): ids with the end id, as 16-bit integers where the vocabulary allows, else 32-bit."""
    with open(tokenizer_path, encoding="utf-8") as file:
        description = file.read()
    from tokenizers import Tokenizer

    dtype = _dtype(max(end_id, Tokenizer.from_str(description).get_vocab_size()))
    shared = docs.sparkSession.sparkContext.broadcast(description)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        if (tokenizer_path, end_id) not in _encoders:
            _encoders.clear()
            _encoders[tokenizer_path, end_id] = Encoder(shared.value, dtype, end_id)
        names, texts = (pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
        return pa.RecordBatch.from_arrays([names, _encoders[tokenizer_path, end_id].encode(texts)], ["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= HELD_BYTES:
                yield made(held)
                held = []
        if held:
            yield made(held)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, ids binary")


# --- codes -----------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(limit):
        both = np.concatenate((leaves, packages))
        place = np.argsort(both, kind="stable")
        levels.append(place < n)
        both = both[place]
        even = len(both) // 2 * 2
        packages = both[0:even:2] + both[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol place)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    codes = np.zeros(len(lengths), np.int64)
    code, last = -1, 0
    for k in order.tolist():
        size = int(lengths[k])
        code = (code + 1) << (size - last)
        last = size
        codes[k] = code
    return codes


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of ``ids``, most significant first, and the bit offset of every ``CHECKPOINT``-th id."""
    sizes = length[ids]
    ends = np.cumsum(sizes)
    at = ends - sizes
    word, shift = at >> 5, at & 31
    value = code[ids].astype(np.uint64) << (64 - sizes - shift).astype(np.uint64)
    words = int(ends[-1] >> 5) + 2
    # bits of different codes never meet, so these sums are below 2**32 and exact
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words)
    out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return out.astype(">u4").tobytes(), at[::CHECKPOINT].astype(np.int64)


def unpack(payloads: list[bytes], offsets: list[np.ndarray], counts: list[int], symbol: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Ids of several blocks; all runs between checkpoints are decoded side by side by table."""
    data = b"".join(payloads) + bytes(8)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in payloads])[:-1])).astype(np.int64)
    lanes = [len(o) for o in offsets]
    at = np.concatenate(offsets) + np.repeat(starts * 8, lanes)
    left = np.full(len(at), CHECKPOINT, np.int64)
    last = np.cumsum(lanes) - 1
    left[last] = np.array(counts) - (np.array(lanes) - 1) * CHECKPOINT
    byte = np.frombuffer(data, np.uint8).astype(np.uint32)
    window = (byte[:-3] << 24) | (byte[1:-2] << 16) | (byte[2:-1] << 8) | byte[3:]  # 32 bits from every byte on
    out = np.zeros((CHECKPOINT, len(at)), np.uint32)
    for step in range(CHECKPOINT):
        live = np.flatnonzero(left > step) if step >= left.min(initial=0) else slice(None)
        here = at[live]
        code = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
        out[step, live] = symbol[code]
        at[live] = here + size[code]
    cuts = np.cumsum(lanes)[:-1]
    return [lane.reshape(-1)[:n] for lane, n in zip(np.split(np.ascontiguousarray(out.T), cuts), counts)]


def decode_table(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code size for every value of the next ``MAX_BITS`` bits."""
    codes = canonical_codes(lengths)
    symbol, size = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.uint8)
    order = np.argsort(codes << (MAX_BITS - lengths))
    span = 1 << (MAX_BITS - lengths[order])
    first = (codes << (MAX_BITS - lengths))[order]
    filled = np.repeat(order, span)
    where = np.repeat(first - np.cumsum(span) + span, span) + np.arange(len(filled))
    symbol[where], size[where] = symbols[filled], lengths[filled]
    return symbol, size


# --- files -----------------------------------------------------------------------------------------

def write(tokens: DataFrame, path: str, largest_id: int) -> None:
    """Write (doc_id, ids) as a file set at ``path``; ``tokens`` must give equal rows when read again."""
    spark, dtype = tokens.sparkSession, _dtype(largest_id)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(largest_id + 1, np.int64)
        for batch in batches:
            column = batch.column(0)
            ids = np.frombuffer(b"".join(column.to_pylist()), dtype)
            total += np.bincount(ids, minlength=largest_id + 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    # at most one row for each id of the vocabulary
    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    symbols, lengths = counts["id"].to_numpy(), code_lengths(counts["n"].to_numpy())
    spark.createDataFrame([(symbols.tolist(), lengths.tolist())], "symbols array<long>, lengths array<long>").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((symbols, lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, size = shared.value
        code, length = np.zeros(largest_id + 1, np.int64), np.zeros(largest_id + 1, np.int64)
        code[used], length[used] = canonical_codes(size), size
        part, number, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []
        waiting = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held).astype(np.int64)
            payload, marks = pack(ids, code, length)
            row = {"part": part, "block": number, "before": before, "doc_ids": names, "doc_tokens": [len(h) for h in held],
                   "checkpoints": marks.tolist(), "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(doc_id)
                held.append(np.frombuffer(ids, dtype))
                waiting += len(held[-1])
                if waiting >= BLOCK_TOKENS:
                    yield block()
                    number, before = number + 1, before + waiting
                    names, held, waiting = [], [], 0
        if held:
            yield block()

    parts = partitions_for(tokens, _PART_BYTES)
    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, _COLUMNS).write.option("compression", "none").parquet(f"{path}/blocks")


_COLUMNS = ("part int, block int, before long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, payload binary")
_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                     ("doc_tokens", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])


def _read(spark, path: str, schema: str, made) -> DataFrame:
    """Per document rows that ``made`` builds from (doc_ids, starts, list of id arrays) of some blocks."""
    codes = spark.read.parquet(f"{path}/codes").first()
    shared = spark.sparkContext.broadcast((np.array(codes["symbols"], np.int64), np.array(codes["lengths"], np.int64)))
    blocks = spark.read.schema(_COLUMNS).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.max(F.col("before") + F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size"))
    # one row for each part of the file set: few beside its blocks, which stay where they are
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("offset"))
    rows = blocks.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("before")).alias("first"), "doc_ids", "doc_tokens", "checkpoints", "payload")
    kept: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(decode_table(*shared.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 40):
                some = batch.slice(lo, 40).to_pydict()
                lengths = [np.array(t, np.int64) for t in some["doc_tokens"]]
                found = unpack(some["payload"], [np.array(c, np.int64) for c in some["checkpoints"]], [int(t.sum()) for t in lengths], *kept[0])
                doc_ids, starts, ids = [], [], []
                for names, first, tokens, decoded in zip(some["doc_ids"], some["first"], lengths, found):
                    ends = np.cumsum(tokens)
                    doc_ids += names
                    starts += (first + ends - tokens).tolist()
                    ids += np.split(decoded, ends[:-1])
                yield made(doc_ids, starts, ids)

    return rows.mapInArrow(run, schema)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, ids): documents of a file set; ids as little-endian unsigned 32-bit integers."""
    def made(doc_ids: list, starts: list, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()),
                                           pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())], ["doc_id", "start", "ids"])

    return _read(spark, path, "doc_id long, start long, ids binary", made)


def digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a file set."""
    def made(doc_ids: list, starts: list, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
             pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", made)
