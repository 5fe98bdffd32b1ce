import math

import pytest

from loomery.errors import ConfigurationError
from loomery.operators import bm25, ranking, vectors

DOCS = [("cv#1", 0, "Python RAG browser automation"), ("cv#2", 1, "Frontend design systems"), ("job#1", 2, "Greenhouse Python automation role"), ("none", 3, None)]


def index(spark, **kw):
    return bm25.build(spark.createDataFrame(DOCS, "id string, ord int, text string"), "id", "text", "ord", **kw)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_bm25_order_limits_and_statistics(spark):
    i = index(spark)
    hits = bm25.search(i, asked(spark, "python automation", "", "zzz"), "query_id", "text", 2).orderBy("query_id", "rank").collect()
    assert [(h.query_id, h.id) for h in hits] == [(0, "cv#1"), (0, "job#1")]
    avg = (4 + 3 + 4 + 0) / 4
    one = math.log(1 + (4 - 2 + 0.5) / 2.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4 / avg))
    assert abs(hits[0].score - 2 * one) < 1e-9
    assert bm25.search(i, asked(spark, "python"), "query_id", "text", 0).count() == 0
    twice = bm25.search(i, asked(spark, "python python"), "query_id", "text", 1).first()
    assert abs(twice.score - 2 * one) < 1e-9


@pytest.mark.parametrize("kw", [{"k1": 0}, {"b": 2}])
def test_bm25_parameters(spark, kw):
    with pytest.raises(ConfigurationError):
        index(spark, **kw)


def test_fusion_prefers_consensus_and_dedupes(spark):
    rows = [(0, l, r + 1, x, 1.0) for l, ids in enumerate((["a", "b", "c"], ["d", "b", "e"])) for r, x in enumerate(ids)]
    lists = spark.createDataFrame(rows, "query_id int, list_no int, rank int, id string, score double")
    got = [r.id for r in ranking.fuse(lists).orderBy("rank").collect()]
    assert got[0] == "b" and sorted(got) == ["a", "b", "c", "d", "e"]
    assert ranking.fuse(lists, limit=2).count() == 2
    assert [r.id for r in ranking.first_wins(lists, 4).orderBy("rank").collect()] == ["a", "b", "c", "d"]


def test_rerank_and_variants(spark):
    pairs = spark.createDataFrame([(0, "q", x, i, t) for i, (x, t) in enumerate([("a", "aaaaaZ"), ("b", "bb"), ("c", None)])], "query_id int, query string, id string, ord int, content string")
    scores = {"aaaaa": 0.2, "bb": 3.0, "": 1.0}
    got = ranking.rerank(pairs, lambda q, c: [scores[x] for x in c], 2, 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("b", 3.0), ("c", 1.0)]
    made = ranking.variants(asked(spark, "q"), lambda t: "- one\ntwo\none\nthree\nfour", 3).orderBy("list_no").collect()
    assert [r.text for r in made] == ["one", "two", "q"]


def test_vector_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (60, 5)).astype(float)
    rows = [(i, i, None if i == 7 else [float(x) for x in row]) for i, row in enumerate(v)]
    stored = spark.createDataFrame(rows, "id int, ord int, vector array<double>")
    queries = stored.where("id < 4").selectExpr("id AS query_id", "vector")
    got = vectors.search(stored, queries, 5).orderBy("query_id", "rank").collect()
    v[7] = 0
    norm = np.linalg.norm(v, axis=1)
    for q in range(4):
        cos = np.where(norm * norm[q] == 0, 0, v @ v[q] / np.where(norm * norm[q] == 0, 1, norm * norm[q]))
        want = sorted(range(60), key=lambda i: (-round(cos[i], 9), i))[:5]
        assert [r.id for r in got if r.query_id == q] == want
    assert vectors.search(stored, queries.limit(0), 5).count() == 0
