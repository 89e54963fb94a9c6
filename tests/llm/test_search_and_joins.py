"""Lexical search, resampling and the range join against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import lexical, rangejoin, resample
from ledgerlens.llm.frames import materialize

WORD = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
ODD = [None, "", "  \n", "...", "ONE", "Äpfel ÄPFEL, x2!", "\x00 nul\x7fdel", "漢字 漢字", "end.", ".start", "a" * 60_000, "word " * 20_000]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def corpus(seed, n, vocabulary=120, longest=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [" ".join(rnd.choices(words, weights, k=rnd.randint(0, longest))) for _ in range(n)]


# ---- lexical search

def plain_search(docs, items, k):
    """docs: (doc_id, text), items: (item_id, text), every pair scored by the formula."""
    terms = [(d, Counter(lower(t) for t in re.findall(WORD, x or ""))) for d, x in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked = Counter(lower(t) for t in re.findall(WORD, text or ""))
        scored = []
        for (doc_id, c), size in zip(terms, sizes):
            m = 25 + (75 * size * n) // max(1, total)
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("values", [[0], [127, 128, 1, 16383, 16384, 2**28, 2**32 - 1], []])
def test_packed_numbers_come_back(values):
    data, ends = lexical.pack(np.array(values, np.int64))
    assert lexical.unpack(data).tolist() == values and (not values or ends[-1] == len(data))


def test_search_equals_scoring_all(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 6000)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "WINDOW", 16)
    monkeypatch.setattr(lexical, "SET_TERMS", 60)
    texts = corpus(1, 700)
    docs = [(i, t) for i, t in enumerate(texts)] + [(2000 + i, t) for i, t in enumerate(texts[:80])]  # ties
    docs += [(3000 + i, t) for i, t in enumerate(ODD)] + [(None, "w1 w2 w3")]
    items = [(i, t) for i, t in enumerate(corpus(2, 30, longest=25))]
    items += [(50, "Äpfel x2 end START"), (51, ""), (52, None), (53, "absent words only"), (54, "w0"), (55, "a" * 60_000), (56, "w1 w1 w1 w7"), (None, "w1")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, term string").repartition(9)
    asked = spark.createDataFrame([(*i, 1) for i in [*items, items[0]]], "item_id long, text string, score int")
    got = sorted(tuple(r) for r in lexical.search_documents(frame, asked, 10).collect())
    assert got == plain_search(docs, [i for i in items if i[0] is not None], 10)
    index = materialize(lexical.build_index(frame))
    assert index.where("term IS NULL").count() >= 9
    assert sorted(tuple(r) for r in lexical.search(index, asked, 3).collect()) == plain_search(docs, [i for i in items if i[0] is not None], 3)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search_documents(docs.limit(0), items).count() == 0
    assert lexical.search_documents(docs, items.limit(0)).count() == 0
    assert [r.doc_id for r in lexical.search_documents(docs, items).collect()] == [1]


def test_blocks_are_rejected_unopened():
    """A rare strong term leaves most blocks of the frequent ones compressed."""
    rnd = random.Random(5)
    texts = []
    for i in range(6000):
        words = ["the"] * rnd.randint(1, 3) + [f"w{rnd.randint(0, 3000)}" for _ in range(20)] + (["rare"] if i % 150 == 0 else [])
        rnd.shuffle(words)
        texts.append(" ".join(words))
    batch, lengths = lexical.shard_lists(0, pa.array(texts))
    rows = batch.to_pylist()
    df = {r["term"]: r["n_docs"] for r in rows}
    statistics = lexical.Statistics(len(texts), int(lengths.sum()), {t: math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * c + 1))) for t, c in df.items()})
    norm = statistics.norm(lengths)
    lists = [(statistics.weight[r["term"]], lexical.PostingList(r, norm, statistics)) for r in rows if r["term"] in ("the", "rare")]
    ids, scores = lexical.answer(lists, np.arange(len(texts)), np.ones(len(texts), bool), 10)
    assert list(zip(ids.tolist(), scores.tolist())) == [(d, s) for _, _, d, s in sorted(plain_search(list(enumerate(texts)), [(0, "the rare")], 10), key=lambda x: x[1])]
    frequent = max(lists, key=lambda x: len(x[1].last))[1]
    assert frequent.opened() < 0.8 * len(frequent.last)


# ---- importance resampling

def plain_resample(docs, target):
    def feats(text):
        w = re.findall(WORD, lower(text))
        return w, [f.encode() for f in w] + [f"{a} {b}".encode() for a, b in zip(w, w[1:])]

    source, wanted = Counter(), Counter()
    for text in (t for _, t in docs):
        source.update(zlib.crc32(f) % 10000 for f in feats(text)[1])
    for text in target:
        wanted.update(zlib.crc32(f) % 10000 for f in feats(text)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000))))

    out, open_ = [], []
    for doc_id, text in docs:
        w, f = feats(text)
        weight = sum(gain(zlib.crc32(x) % 10000) for x in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(w) >= 20:
                open_.append((-score, doc_id))
        out.append([doc_id, len(f), weight, score, None])
    place = {d: r + 1 for r, (_, d) in enumerate(sorted(open_)[:25 * len(open_) // 100])}
    return sorted(([*r[:4], place.get(r[0])] for r in out), key=str)


def test_resampling_equals_the_formula(spark):
    docs = [(i, t) for i, t in enumerate(corpus(3, 300))] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "w1 " * 30)]
    target = corpus(4, 20, vocabulary=30) + [None, ""]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rank string, weight int").repartition(6)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in resample.resample(frame, goal).collect()), key=str)
    assert got == plain_resample(docs, target)
    assert resample.resample(frame.limit(0), goal).count() == 0


def test_repeated_rows_are_drawn_one_by_one(spark):
    frame = spark.createDataFrame([(7, "w1 w2 " * 15)] * 8, "doc_id long, text string")
    rows = resample.resample(frame, frame.selectExpr("doc_id AS item_id", "text")).collect()
    assert len(rows) == 8 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2]


# ---- range join

def plain_links(rows, least=0.95):
    """rows: (vec_id, vector or None) -> sorted (vec_id, n_links, component_id, kept)."""
    def sound(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    at = [i for i, (k, v) in enumerate(rows) if k is not None and sound(v)]
    m = np.array([[*rows[i][1], *[0.0] * (8 - len(rows[i][1]))] for i in at])
    m = m / np.abs(m).max(axis=1)[:, None]
    m = m / np.linalg.norm(m, axis=1)[:, None]
    close = m @ m.T >= least
    parent = {k: k for k, _ in rows if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    n = {}
    for p, i in enumerate(at):
        n[i] = int(close[p].sum()) - 1
        for q in np.flatnonzero(close[p]).tolist():
            a, b = find(rows[i][0]), find(rows[at[q]][0])
            parent[max(a, b)] = min(a, b)
    return sorted(((k, n.get(i, 0), find(k) if k is not None else None, k is None or find(k) == k) for i, (k, _) in enumerate(rows)), key=str)


def vectors(seed):
    rnd = np.random.default_rng(seed)
    tight = rnd.normal(size=(1, 8)) + rnd.normal(size=(150, 8)) * 0.02  # one settled group of a third of the rows
    loose = np.repeat(rnd.normal(size=(6, 8)), 25, axis=0) + rnd.normal(size=(150, 8)) * 0.15
    chain = np.array([[math.cos(0.25 * i), math.sin(0.25 * i)] + [0.0] * 6 for i in range(20)])
    free = rnd.normal(size=(100, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([tight, loose, chain, free]))]
    rows += [(1000 + i, rows[i * 5][1]) for i in range(50)] + [(1100 + i, [2.0 * x for x in rows[3][1]]) for i in range(30)]  # copies, multiples
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, None]), (2004, [float("nan")] * 8), (2005, [float("inf")] * 8), (None, rows[0][1])]
    rows += [(2006, [1e-300] * 8), (2007, [1e300] * 8), (2008, [1.0]), (2009, [-0.0, 3.0]), (5, rows[5][1]), (2010, rows[200][1]), (2010, [-x for x in rows[200][1]])]
    return rows


@pytest.mark.parametrize("unit_bytes", [64 * 8, 64 * 40, 4_000_000])
def test_range_join_equals_all_pairs(spark, unit_bytes):
    rows = vectors(3)
    frame = spark.createDataFrame([(*r, 1, 0) for r in rows], "vec_id long, embedding array<double>, n_links int, label int").repartition(4)
    got = sorted((tuple(r) for r in rangejoin.range_join(frame, 0.95, unit_bytes).collect()), key=str)
    assert got == plain_links(rows)
    assert rangejoin.range_join(frame.limit(0)).count() == 0


def test_settled_groups_are_not_compared(spark):
    """Rows in one tight group: cells of ten, yet hardly any row is replicated and no links are listed."""
    rnd = np.random.default_rng(9)
    points = rnd.normal(size=(1, 16)) + rnd.normal(size=(3000, 16)) * 0.005
    frame = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    found = rangejoin.unit_vectors(frame)
    classes = materialize(found.selectExpr("vec_id AS rep", "1L AS n", "u", "vec_id AS cid"))
    placed, whole = rangejoin.partition(classes, 16, math.sqrt(0.1), 10)
    assert placed.where("NOT home").count() < 300 and placed.where("NOT endswith(cell, '!')").count() == 0
    assert whole.count() <= 3000 * rangejoin.FANOUT
    rows = rangejoin.range_join(frame, unit_bytes=10 * 128).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(2999, 0)}
