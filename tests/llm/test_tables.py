import random

import numpy as np
import pytest

from checks.compare import difference, oracle_connection
from ledgerlens.llm import catalog, components, topk, urls
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, small, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    assert difference(got, oracle_connection(small).execute(catalog.ORACLES[name]).df()) is None


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 200), rnd.randint(100, 200)) for _ in range(60)] + [(None, 5), (3, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def best(rows, k):
    out = []
    for q, v in rows:
        if q % 50 == 0:
            scores = sorted((-int(np.dot(v, c)), i) for i, c in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("rows", [3, 700])
def test_search_equals_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "SLICE_ROWS", 300)
    monkeypatch.setattr(topk, "LEAF", 8)
    rnd = np.random.default_rng(rows)
    centres = rnd.normal(size=(6, 8))
    vectors = [(i, [float(x) for x in centres[i % 6] + rnd.normal(size=8) * 0.2]) for i in range(rows)]
    vectors += [(1000 + i, list(vectors[i][1])) for i in range(min(rows, 60))]  # ties
    odd = [(5000, None), (5050, [1.0, None]), (5100, [float("nan")] * 8), (5150, [float("inf")] * 8), (None, [0.0] * 8)]
    whole = topk.integers(spark.createDataFrame([(*r, 1) for r in [*vectors, *odd]], "vec_id long, embedding array<float>, score int"))
    got = sorted(tuple(r) for r in topk.top_k(whole, whole.where("vec_id % 50 = 0"), 5).collect())
    rounded = [(r.vec_id, r.v) for r in whole.collect()]
    assert got == best(rounded, 5)


def plain_best(queries, query_ids, points, ids, k):
    out = []
    for q, i in zip(queries.tolist(), query_ids.tolist()):
        scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for c, j in zip(points.tolist(), ids.tolist()) if j != i)[:k]
        out.append([(-s, j) for s, j in scores])
    return out


def test_clusters_are_pruned_before_they_are_scored():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(200, 16)) * 200
    points = np.rint(centres[np.arange(8192) % 200] + rnd.normal(size=(8192, 16)) * 4).astype(np.int64)
    queries = np.rint(centres[np.arange(512) % 200] + rnd.normal(size=(512, 16)) * 4).astype(np.int64)
    search = topk.Search(queries, np.arange(512) + 100_000, points, np.arange(8192), 5)
    search.run()
    assert search.pairs < 0.25 * 512 * 8192
    got = [list(zip(s, f)) for s, f in zip(search.score[:40].tolist(), search.found[:40].tolist())]
    assert got == plain_best(queries[:40], np.arange(40) + 100_000, points, np.arange(8192), 5)


@pytest.mark.parametrize("scale", [3, 1 << 20, 1 << 29])
def test_scores_are_exact_integers(scale):
    rnd = np.random.default_rng(scale)
    points = rnd.integers(-scale, scale + 1, (300, 4))
    search = topk.Search(points[:40], np.arange(40), points, np.arange(300), 7)
    search.run()
    assert [list(zip(s, f)) for s, f in zip(search.score.tolist(), search.found.tolist())] == plain_best(points[:40], np.arange(40), points, np.arange(300), 7)


def test_scores_beyond_64_bits_are_an_error():
    points = np.full((10, 4), 1 << 31)
    with pytest.raises(OverflowError):
        topk.Search(points, np.arange(10), points, np.arange(10) + 20, 3).run()


def test_search_of_nothing(spark):
    none = topk.integers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).count() == 0


def test_url_rules_and_list(spark, monkeypatch):
    rows = [(1, "https://WWW.Example.org/es/1"), (2, "http://a.example.org/en/12?x"), (3, "http://example.org"), (4, "http://x.com/de/#t"),
            (5, "http://x.com/fr/9"), (6, None), (7, "no scheme"), (8, ""), (9, "http://bad.net/p.html?u=1"), (10, "http://www.bad.net/p/"),
            (11, "http://good.net/p"), (11, "http://good.net/p")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("bad.net/p",), ("bad.net/p",), (None,), ("",)], "key string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, listed).collect()}
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3] == ("example.org", "", None, "allow") and got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9][3] == got[10][3] == "block" and got[11][3] == "allow"
    assert urls.judge(pages, listed).count() == len(rows) and urls.judge(pages.limit(0), listed).count() == 0
    # a filter full of false hits changes nothing
    monkeypatch.setattr(urls, "bloom", lambda keys: np.full(urls._BLOCKS * 8, np.uint64(0xFFFFFFFFFFFFFFFF)))
    assert {r.page_id: tuple(r)[1:] for r in urls.judge(pages, listed).collect()} == got


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('h', id) AS key")
    words = urls.bloom(keys)
    tested = urls.possible(keys.selectExpr("1L AS page_id", "'' AS host", "'' AS path", "key"), words)
    assert tested.where("NOT maybe").count() == 0
    others = urls.possible(keys.selectExpr("1L AS page_id", "'' AS host", "'' AS path", "concat('n', key) AS key"), words)
    assert others.where("maybe").count() < 60


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline
    from ledgerlens.llm import bpe, decontam, pii, toxicity

    item = "a passage of some length that a benchmark asks about, word by word"
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(8, 80)))) for i in range(600)]
    rows = [(i, t + " vile" if i % 6 == 0 else t) for i, t in rows]
    rows += [(1000 + i, rows[i * 7 + 1][1] + " end") for i in range(40)] + [(2000, f"see {item} there"), (2001, "mail a.b@c.de now please"), (2002, None), (2003, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    table = toxicity._table(toxicity.fit(docs, labels))
    left = [(i, t) for i, t in rows if toxicity._score(table, t) < toxicity.THRESHOLD]
    assert 2000 in dict(left) and sum(i % 6 == 0 for i, _ in left if i < 600) <= 5
    groups = brute.components(left, 5, 80)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    index = decontam.Index([(1, decontam.normal(item))])
    left = [(i, pii.redact(t)) for i, t in left if not decontam.matches(index, t)]
    codec = bpe.Codec(bpe.load_ranks(catalog.public_tokenizers.path(catalog.RANKS)), catalog.public_tokenizers.PATTERN)
    assert got == {i: len(codec.encode([t])[0]) // 4 for i, t in left}
    assert 2000 not in got and got[2002] == got[2003] == 0
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["toxicity", "near_duplicates", "decontamination", "pii", "byte_bpe"]
