import random

import pytest

from loomery.operators import blocks, bm25


def rows(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(n)))
    docs = [(i, f"d{i}", f"g{i % 3}", text(30)) for i in range(300)] + [(300, "d300", "g0", None), (301, "d301", None, "a b")]
    asked = [(i, f"g{i % 4}", text(6)) for i in range(40)] + [(40, "g1", None), (41, "g1", "zzz"), (42, "g2", "a a a b")]
    return spark.createDataFrame(docs, "ord int, id string, grp string, text string").repartition(5), spark.createDataFrame(asked, "query_id int, grp string, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("group", [None, "grp"])
def test_blocks_equal_all_scores(spark, monkeypatch, group):
    """the best documents without a row for each pair are those of all pairs, in any slices and passes."""
    docs, queries = rows(spark)
    index = bm25.build(docs, "id", "text", "ord", group)
    found = bm25.search(index, queries, "query_id", "text", 7, group)
    assert "MapInArrow" in plan(found) and "tf#" not in plan(found)  # no postings are joined to queries
    monkeypatch.setattr(blocks, "FIRST_CELLS", 3)
    monkeypatch.setattr(blocks, "MOST_WORDS", 50)
    several = bm25.search(index, queries, "query_id", "text", 7, group)
    index.documents = None
    want = sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in bm25.search(index, queries, "query_id", "text", 7, group).collect())
    for got in (found, several):
        assert sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in got.collect()) == want and len(want) > 150


def tables(spark, folder):
    docs, queries = rows(spark)
    docs.selectExpr("cast(ord as bigint) doc_id", "text").write.parquet(f"{folder}/documents.parquet")
    queries.selectExpr("cast(query_id * 100 as bigint) ord", "text question", "reverse(text) reference").write.parquet(f"{folder}/eval_cases.parquet")
    spark.range(500).selectExpr("id vec_id", "array(cast(id % 7 as float), 1f, cast(id % 5 as float)) embedding", "0 label").write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("name", ["rerank_topn", "rrf_fuse", "hybrid_topk", "multi_query", "rag_prompt"])
def test_no_row_for_a_pair(spark, tmp_path, name):
    """F3 to F7: what the searches build on ranks without postings; contents are fetched for hits only."""
    from loomery.plans import search

    tables(spark, str(tmp_path))
    out = search.QUERIES[name](spark, str(tmp_path))
    whole = plan(out)
    assert "tf#" not in whole and ("MapInArrow" in whole or "LeftSemi" in whole) and out.count() > 0
