"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Each text becomes the set of hashes of its word shingles; its sketch is the k smallest. Texts with
   equal sets form one class at once, so groups of copies cost one row from here on.
2. Inverted lists: two sets with Jaccard ``t`` share at least ``least_overlap(k, t)`` of the retained
   values (short of a chance under 1e-6 a pair at the threshold, less above it; certain where a sketch
   is the whole set). So only the rarest ``k - least + 1`` retained values of a set need listing:
   very frequent shingles are left out of the lists without losing a pair.
3. Every list is turned into a star around its smallest member, so a list of n costs n rows, never n**2.
   Two sets that share a listed value are in the same star. Large stars are cut into blocks.
4. First every block is compared within itself and with the star's head, which takes n rows. Members of one
   component need no further comparison with each other: only those outside the head's component are
   compared with the whole star, in pairs of their blocks and all blocks. So a star of near copies of one text is
   written once, and one of n members with u outside about n * u / 400 times.
5. In each unit the union sketches of pairs are formed and estimate their similarity; members
   with a possible partner stay, again at most one row a member.
6. The full sets of those members are fetched once and verified exactly inside the units; a spanning
   set of the verified links leaves each unit, and components follow from them.

Documents without words are linked with nothing. Rows that share a doc_id count as one document with the
links of each; rows with a null doc_id form no links, are never kept out, and have a null component.
Repeated rows are returned as often as they come. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.order import salted_join
from ledgerlens.llm.components import components
from ledgerlens.llm.frames import map_batches, materialize
from ledgerlens.llm.hashing import shingle_set

SKETCH = 32
BLOCK, BLOCK_SHINGLES = 400, 500_000  # members and shingles of a block, about
_MISS = 1e-6


def least_overlap(k: int, percent: int) -> int:
    """Largest c such that a pair at the threshold shares fewer than c of k retained values with chance below 1e-6."""
    t, tail, c = percent / 100, 0.0, 0
    while c < k:
        tail += comb(k, c) * t ** c * (1 - t) ** (k - c)
        if tail > _MISS:
            break
        c += 1
    return max(1, c)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, key, sketch): set size, digest of the whole set, smallest hashes (as signed 64-bit)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "key", "sketch"])

    return map_batches(_texts(docs), run, "doc_id long, n long, key binary, sketch array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _listed(classes: DataFrame, percent: int) -> DataFrame:
    """(value, rep, n): the inverted lists over the rarest retained values of every class, of two members or more."""
    least = least_overlap(SKETCH, percent)
    posts = classes.select("rep", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    often = posts.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    shared = posts.join(often, "value").groupBy("rep", "n", "size").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("values"))
    need = F.greatest(F.lit(1), F.floor(F.col("size") * least / SKETCH)).cast("int")
    # values of one member only are the rarest of all: they use up places in the list without making one
    places = F.col("size") - need + 1 - (F.col("size") - F.size("values"))
    kept = shared.where(places > 0).select("rep", "n", F.explode(F.slice("values", 1, places)).alias("v"))
    return kept.select(F.col("v.value").alias("value"), "rep", "n")


def _stars(listed: DataFrame) -> DataFrame:
    """(star, rep, n) without repeats: every member of a list with the list's smallest member, itself included."""
    heads = listed.groupBy("value").agg(F.min("rep").alias("star"), F.max("rep").alias("top")).where("star < top")
    return listed.join(heads.select("value", "star"), "value").select("star", "rep", "n").distinct()


def _blocks(members: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def _block_of(member: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(member), F.col(blocks)).cast("int")


def _unit(low: Column, high: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high")).alias("unit")


def _dealt(stars: DataFrame) -> DataFrame:
    """(star, rep, n, block, blocks): members dealt to the blocks of their star."""
    sizes = stars.groupBy("star").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    # a star may hold a large share of all rows; those of one block need no row of their own
    sized = salted_join(stars, sizes.where("blocks > 1"), ["star"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return sized.withColumn("block", _block_of("rep", "blocks"))


def _first_units(dealt: DataFrame) -> DataFrame:
    """(star, unit, rep, label): every block by itself, with the head of its star; each member has a label of its own."""
    block = F.col("block")
    heads = dealt.where("rep = star").select("star", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("guest"), "block")
    rows = dealt.select("star", _unit(block, block), "rep").union(
        heads.where("guest <> block").select("star", _unit(F.col("guest"), F.col("guest")), F.col("star").alias("rep")))
    return rows.withColumn("label", F.col("rep"))


def _second_units(dealt: DataFrame, groups: DataFrame) -> DataFrame:
    """(star, unit, rep, label): members outside their head's component, in pairs of their blocks and all blocks of the star.

    ``groups`` are the components so far; two members with one label are not compared.
    """
    large = dealt.where("blocks > 1")
    label = F.coalesce("component", "rep").alias("label")
    rows = large.join(groups, F.col("rep") == F.col("node"), "left").select("star", "rep", "n", "block", "blocks", label)
    heads = rows.where("rep = star").select("star", F.col("label").alias("core"))
    apart = F.col("label") != F.col("core")
    rows = materialize(salted_join(rows, heads, ["star"]).withColumn("apart", apart).drop("core"))
    sizes = rows.where("apart").groupBy("star").agg(_blocks(F.count("*"), F.sum("n")).alias("shares"))
    rows = salted_join(rows, sizes, ["star"]).withColumn("share", _block_of("rep", "shares"))
    other = F.col("other")
    everyone = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    outside = rows.where("apart").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    return everyone.select("star", _unit(other, F.col("block")), "rep", "label").union(
        outside.select("star", _unit(F.col("share"), other), "rep", "label"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal (star, unit) of a sorted stream; a run is bounded by two blocks."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        star, unit = batch.column("star").to_numpy(), batch.column("unit_no").to_numpy()
        cuts = [0, *(np.flatnonzero((star[1:] != star[:-1]) | (unit[1:] != unit[:-1])) + 1).tolist(), len(star)]
        table = pa.Table.from_batches([batch])
        for lo, hi in zip(cuts, cuts[1:]):
            if last is not None and last != (star[lo], unit[lo]):
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
            last = (star[lo], unit[lo])
    if held:
        yield pa.concat_tables(held)


def _by_unit(units: DataFrame, values: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """``run`` on each unit's rows joined with ``values`` by rep."""
    rows = units.join(values, "rep").select(
        "star", F.xxhash64("unit.low", "unit.high").alias("unit_no"), "unit", "rep", "label", *columns)
    rows = rows.repartition("star", "unit_no").sortWithinPartitions("star", "unit_no")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        for unit in _grouped(batches):
            if unit.num_rows > 1 and (made := run(unit)) is not None:
                out.append(made)
                if len(out) >= 500:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out = []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return rows.mapInArrow(over, schema)


def _union_sketch(left: np.ndarray, right: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of both sets in, and size of, the sketch of the union of each row's sets; ``none`` fills up short rows."""
    merged = np.sort(np.concatenate([left, right], axis=1), axis=1)
    real = merged < none
    again = (merged[:, 1:] == merged[:, :-1]) & real[:, 1:]
    place = np.cumsum(np.concatenate([real[:, :1], real[:, 1:] & ~again], axis=1), axis=1)
    return (again & (place[:, 1:] <= SKETCH)).sum(axis=1), np.minimum(place[:, -1], SKETCH)


def _hopeful(units: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(star, unit, rep, label): members whose union sketch with a member of another label can reach the threshold."""
    least = least_overlap(SKETCH, percent)

    def run(unit: pa.Table) -> pa.RecordBatch | None:
        sketch = unit.column("sketch").combine_chunks()
        flat = sketch.flatten().to_numpy().view(np.uint64)
        sizes = np.diff(sketch.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        value, index = np.unique(flat, return_inverse=True)
        ranks = np.full((len(sizes), SKETCH), len(value), np.int32)
        ranks[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = index
        shared = np.bincount(index)[index] > 1
        _, index = np.unique(index[shared], return_inverse=True)
        if not len(index):
            return None
        matrix = np.zeros((len(sizes), index.max() + 1), np.float32)
        matrix[owner[shared], index] = 1
        n, label = unit.column("n").to_numpy(), unit.column("label").to_numpy()

        def reaches(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            both, size = _union_sketch(ranks[i], ranks[j], len(value))
            return np.where(size == SKETCH, both >= least, 100 * both >= percent * size)  # a short one is the union itself

        hope = np.zeros(len(sizes), bool)
        for lo in range(0, len(sizes), 500):
            both = matrix[lo:lo + 500] @ matrix.T  # no less than the shared values of the union's sketch
            small, large = np.minimum(n[lo:lo + 500, None], n[None]), np.maximum(n[lo:lo + 500, None], n[None])
            ok = (both > 0) & (100 * small >= percent * large) & (label[lo:lo + 500, None] != label[None])
            ok &= both >= np.minimum(least, np.floor(np.minimum(sizes[lo:lo + 500, None], sizes[None]) * (percent / 100)))
            first = np.flatnonzero(ok.any(axis=1))  # the likeliest partner settles most members
            likely = np.where(ok[first], both[first], -1).argmax(axis=1)
            hope[lo + first] = reaches(lo + first, likely)
            ok[hope[lo:lo + 500]] = False
            i, j = np.nonzero(ok)
            for at in range(0, len(i), 20_000):
                row, partner = lo + i[at:at + 20_000], j[at:at + 20_000]
                hope[row[reaches(row, partner)]] = True
        if not hope.any():
            return None
        return unit.filter(pa.array(hope)).select(["star", "unit", "rep", "label"]).combine_chunks().to_batches()[0]

    return _by_unit(units, classes.select("rep", "n", "sketch"), ["n", "sketch"], run,
                    "star long, unit struct<low:int,high:int>, rep long, label long")


def _links(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): verified links of each unit that hold its components together."""
    def run(unit: pa.Table) -> pa.RecordBatch | None:
        rep = unit.column("rep").to_numpy()
        members = [np.frombuffer(s, np.uint64) for s in unit.column("set").to_pylist()]
        n = np.array([len(m) for m in members])
        order = np.argsort(n, kind="stable")
        label = unit.column("label").to_numpy().copy()
        _, index = np.unique(np.concatenate(members), return_inverse=True)
        often = np.bincount(index)
        column = np.cumsum(often > 1) - 1  # values of one member add nothing to an intersection
        ends = np.cumsum(n)
        inside = [column[i[often[i] > 1]] for i in np.split(index, ends[:-1])]
        out_a, out_b = [], []
        width = int(column[-1]) + 1 if len(column) else 0
        for place, x in enumerate(order.tolist()):
            rest = order[place + 1:]
            rest = rest[(100 * n[x] >= percent * n[rest]) & (label[rest] != label[x])]
            if not len(rest):
                continue
            mark = np.zeros(width + 1, bool)
            mark[inside[x]] = True
            lengths = np.array([len(inside[y]) for y in rest.tolist()])
            hits = np.concatenate(([0], np.cumsum(mark[np.concatenate([inside[y] for y in rest.tolist()])])))
            stops = np.cumsum(lengths)
            common = hits[stops] - hits[stops - lengths]
            for y in rest[100 * common >= percent * (n[x] + n[rest] - common)].tolist():
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    out_a.append(rep[x])
                    out_b.append(rep[y])
        if not out_a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return _by_unit(units, sets, ["set"], run, "a long, b long")


def _sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(rep, set): full sets of the documents named by ``reps``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

    wanted = _texts(docs).join(reps, F.col("doc_id") == F.col("rep"), "left_semi")
    return map_batches(wanted, run, "rep long, set binary")


def _verified(docs: DataFrame, units: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): the links inside ``units``."""
    hopeful = materialize(_hopeful(materialize(units), classes, percent))
    return materialize(_links(hopeful, _sets(docs, hopeful.select("rep").distinct(), width), percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for every row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their sets of ``width``-word
    shingles; component_id is the smallest doc_id reachable over links, itself included; class_id the
    smallest doc_id with the same set; kept marks the component's smallest document.
    """
    found = materialize(sketches(docs, width))
    classes = materialize(found.where("n > 0 AND doc_id IS NOT NULL").groupBy("key", "n").agg(
        F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")))
    dealt = materialize(_dealt(_stars(_listed(classes, percent))))
    links = _verified(docs, _first_units(dealt), classes, width, percent)
    if not dealt.where("blocks > 1").isEmpty():
        links = links.union(_verified(docs, _second_units(dealt, components(links)), classes, width, percent))
    # rows that share a doc_id but not a set are tied through their classes
    shared = (found.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high"))
              .where("low <> high").select("doc_id"))
    tied = found.join(shared, "doc_id", "left_semi").where("n > 0").join(classes.select("key", "rep"), "key")
    edges = links.union(tied.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    groups = components(edges)
    rows = (found.join(classes.select("key", "rep"), "key", "left")
            .join(groups, F.coalesce("rep", "doc_id") == F.col("node"), "left"))
    class_id = F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", class_id))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), class_id.alias("class_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, with all their columns."""
    mark = "duplicate of a smaller document"
    gone = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(mark), "left_anti")


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (
    SELECT doc_id, len(s) AS n FROM sets
), items AS (
    SELECT doc_id, unnest(s) AS v FROM sets
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM items x JOIN items y ON x.v = y.v AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, least) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT b, least FROM reach JOIN edges ON a = doc_id WHERE least < b
)
SELECT doc_id, n AS n_shingles, min(least) AS component_id, doc_id = min(least) AS kept FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n
"""
