"""Lexical, vector, fused and reranked search. The queries are all eval cases and vectors whose number is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import bm25, ranking, vectors
from loomery.plans.tables import table
from loomery.session import checkpoint
from loomery.sources import stores

K = 10


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def _index(spark, folder):
    return bm25.build(_docs(spark, folder), "doc_id", "text")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_cases").where("ord % 100 = 0").select(F.col("ord").alias("query_id"), F.col("question").alias("text"), "reference").distinct()


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"), "label")


def _out(ranked: DataFrame, name: str = "score") -> DataFrame:
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round(name, 6).alias("score"))


def _with_content(spark: SparkSession, folder: str, hits: DataFrame) -> DataFrame:
    """Only the texts that are hit are shuffled."""
    hits = checkpoint(hits)
    texts = _docs(spark, folder).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return hits.join(texts.join(bm25.small(hits.select("id").distinct()), "id", "left_semi"), "id")


def bm25_corpus_stats(spark, folder):
    return _index(spark, folder).stats.select(F.col("n").cast("bigint").alias("n"), F.round("avgdl", 6).alias("avgdl"))


def bm25_doc_freq(spark, folder):
    return _index(spark, folder).frequencies.select("token", F.col("df").cast("bigint").alias("df"))


def bm25_topk(spark, folder):
    return _out(bm25.search(_index(spark, folder), _questions(spark, folder), "query_id", "text", K))


def bm25_single_query(spark, folder):
    asked = spark.createDataFrame([(0, "the policy of the invoice pipeline the")], "query_id bigint, text string")
    return _out(bm25.search(_index(spark, folder), asked, "query_id", "text", K))


def vector_topk(spark, folder):
    v = _vectors(spark, folder)
    return _out(vectors.search(v.drop("label"), v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), K))


def vector_topk_after_delete(spark, folder):
    v = _vectors(spark, folder)
    left = vectors.without(v.drop("label"), v.where("id % 7 = 3"))
    return _out(vectors.search(left, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), K))


def vector_label_agreement(spark, folder):
    v = _vectors(spark, folder)
    hits = vectors.search(v.drop("label"), v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), K)
    labels = v.select("id", "label")
    both = hits.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("asked")), "query_id")
    return both.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("asked")).cast("int")), 6).alias("agreement"))


def _lists(spark, folder, fetch):
    asked = _questions(spark, folder)
    lexical = bm25.search(_index(spark, folder), asked, "query_id", "text", fetch)
    v = _vectors(spark, folder).drop("label")
    dense = vectors.search(v, v.join(asked.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), "vector"), fetch)
    return lexical.select("query_id", F.lit(0).alias("list_no"), "rank", "id", "score").unionByName(dense.select("query_id", F.lit(1).alias("list_no"), "rank", "id", "score"))


def hybrid_topk(spark, folder):
    return _out(ranking.fuse(_lists(spark, folder, ranking.fetch_size(5)), limit=5), "fused")


def rrf_fuse(spark, folder):
    fused = ranking.fuse(_lists(spark, folder, K))
    return fused.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("fused", 9).alias("fused"), F.col("list_no").cast("bigint").alias("list_no"))


def multi_query(spark, folder):
    asked = _questions(spark, folder)
    texts = asked.select("query_id", F.posexplode(F.array("reference", "text")).alias("list_no", "text")).where("text IS NOT NULL")
    index = _index(spark, folder)
    several = texts.select(F.struct("query_id", "list_no").alias("variant"), "text")
    found = bm25.search(index, several, "variant", "text", 5)
    lists = found.select("query_id.query_id", "query_id.list_no", "rank", "id", "score")
    return ranking.first_wins(lists, 5).select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.col("list_no").cast("bigint").alias("list_no"))


def rerank_topn(spark, folder):
    asked = _questions(spark, folder)
    hits = bm25.search(_index(spark, folder), asked, "query_id", "text", 20)
    pairs = _with_content(spark, folder, hits.select("query_id", "id", "ord")).join(asked.select("query_id", F.col("text").alias("query")), "query_id")
    return _out(ranking.rerank(pairs, ranking.overlap_scorer, 3))


def rag_prompt(spark, folder):
    hits = bm25.search(_index(spark, folder), _questions(spark, folder), "query_id", "text", 3)
    return ranking.prompt(_with_content(spark, folder, hits)).select("query_id", F.md5("context").alias("context_md5"))


def _store(spark, folder):
    return table(spark, folder, "doc_store").dropDuplicates(["ord"])


def doc_list_filtered(spark, folder):
    return stores.listed(_store(spark, folder), {"mime_type": "text/markdown"}, 100).select("ord", "id")


def doc_get_many(spark, folder):
    docs = _store(spark, folder)
    wanted = docs.where("ord % 100 = 0").select("id", F.col("ord").alias("pos"))
    return stores.fetched(docs, wanted).select("pos", "id", F.md5("content").alias("content_md5"))


def doc_upsert_latest(spark, folder):
    log = table(spark, folder, "documents").select("workspace", "text", "created_at", F.col("doc_id").alias("ord"), "doc_id")
    return stores.upserted(log, "workspace", ["created_at", "doc_id"]).select("workspace", "doc_id", F.col("ord").alias("first_ord"))


def doc_delete(spark, folder):
    docs = _store(spark, folder)
    return stores.deleted(docs, docs.where("metadata['mime_type'] IS NULL")).select("id", F.md5("content").alias("content_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_corpus_stats, bm25_doc_freq, bm25_topk, bm25_single_query, vector_topk, vector_topk_after_delete, vector_label_agreement, rrf_fuse, hybrid_topk, multi_query,
        rerank_topn, rag_prompt, doc_list_filtered, doc_get_many, doc_upsert_latest, doc_delete,
    )
}


def bm25_ctes(corpus: str, queries: str) -> str:
    """CTEs up to ``lexical(query_id, id, ord, score, rank)``; ``corpus`` gives (id, text), ``queries`` (query_id, text)."""
    return rf"""
corpus AS ({corpus}),
tokens AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS token FROM corpus),
lengths AS (SELECT c.id, coalesce(l.dl, 0) AS dl FROM corpus c LEFT JOIN (SELECT id, count(*) AS dl FROM tokens GROUP BY id) l USING (id)),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
tf AS (SELECT id, token, count(*) AS tf FROM tokens GROUP BY id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
asked AS ({queries}),
qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS token FROM asked) GROUP BY ALL),
scored AS (SELECT query_id, id, sum(times * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
  FROM qt JOIN tf USING (token) JOIN df USING (token) JOIN lengths USING (id) CROSS JOIN stats GROUP BY query_id, id),
lexical AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored WHERE score > 0)"""


_CORPUS = "SELECT doc_id AS id, text FROM documents"
_ASKED = "SELECT DISTINCT ord AS query_id, question AS text, reference FROM eval_cases WHERE ord % 100 = 0"
_BM25 = bm25_ctes(_CORPUS, _ASKED)


def _dense(k: int, asked: str, where: str = "true") -> str:
    return f"""dense AS (SELECT query_id, id, score, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
  FROM embeddings q CROSS JOIN embeddings v WHERE {asked} AND {where}) WHERE rank <= {k})"""


_EVERY = "q.vec_id % 100 = 0"
_BOTH = "q.vec_id IN (SELECT query_id FROM asked)"
_RRF = """lists AS (SELECT query_id, 0 AS list_no, rank, id, score FROM lexical WHERE rank <= {k} UNION ALL SELECT query_id, 1, rank, id, score FROM dense),
summed AS (SELECT query_id, id, sum(1e0 / (60 + rank)) AS fused, min(list_no * 1000000 + rank) AS first, arg_max(list_no, (score, -list_no)) AS list_no FROM lists GROUP BY query_id, id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, first, id) AS rank FROM summed)"""
_STORE = "(SELECT * FROM doc_store QUALIFY row_number() OVER (PARTITION BY ord ORDER BY loaded_at) = 1)"

ORACLE = {
    "bm25_corpus_stats": f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_doc_freq": f"WITH {_BM25} SELECT token, df FROM df",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, rank, id, round(score, 6) AS score FROM lexical WHERE rank <= {K}",
    "bm25_single_query": f"WITH {bm25_ctes(_CORPUS, 'SELECT 0::BIGINT AS query_id, $$the policy of the invoice pipeline the$$ AS text')} SELECT query_id, rank, id, round(score, 6) AS score FROM lexical WHERE rank <= {K}",
    "vector_topk": f"WITH {_dense(K, _EVERY)} SELECT query_id, rank, id, round(score, 6) AS score FROM dense",
    "vector_topk_after_delete": f"WITH {_dense(K, _EVERY, 'v.vec_id % 7 <> 3')} SELECT query_id, rank, id, round(score, 6) AS score FROM dense",
    "vector_label_agreement": f"WITH {_dense(K, _EVERY)} SELECT query_id, round(avg(CASE WHEN a.label = b.label THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM dense JOIN embeddings a ON a.vec_id = id JOIN embeddings b ON b.vec_id = query_id GROUP BY query_id",
    "rrf_fuse": f"WITH {_BM25}, {_dense(K, _BOTH)}, {_RRF.format(k=K)} SELECT query_id, id, rank, round(fused, 9) AS fused, list_no::BIGINT AS list_no FROM fused",
    "hybrid_topk": f"WITH {_BM25}, {_dense(20, _BOTH)}, {_RRF.format(k=20)} SELECT query_id, rank, id, round(fused, 6) AS score FROM fused WHERE rank <= 5",
    "multi_query": "WITH "
    + bm25_ctes(_CORPUS, "SELECT query_id * 10 + l AS query_id, text FROM (SELECT ord AS query_id, 0 AS l, reference AS text FROM eval_cases WHERE ord % 100 = 0 UNION SELECT ord, 1, question FROM eval_cases WHERE ord % 100 = 0) WHERE text IS NOT NULL")
    + """, lists AS (SELECT query_id // 10 AS query_id, query_id % 10 AS list_no, rank AS r, id FROM lexical WHERE rank <= 5),
once AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY list_no, r) = 1)
SELECT query_id, rank, id, list_no FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY list_no, r) AS rank, id, list_no FROM once) WHERE rank <= 5""",
    "rerank_topn": rf"""WITH {_BM25}, pairs AS (SELECT l.query_id, l.id, list_distinct(list_filter(string_split_regex(lower(a.text), '\s+'), lambda x: x <> '')) AS q,
  list_distinct(list_filter(string_split_regex(lower(substring(d.text, 1, 1200)), '\s+'), lambda x: x <> '')) AS c FROM lexical l JOIN asked a USING (query_id) JOIN documents d ON d.doc_id = l.id WHERE rank <= 20),
again AS (SELECT query_id, id, len(list_intersect(q, c))::DOUBLE / len(q) AS score FROM pairs)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, round(score, 6) AS score FROM again) WHERE rank <= 3""",
    "rag_prompt": f"WITH {_BM25} SELECT query_id, md5(string_agg('[' || rank || '] ' || d.text, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM lexical JOIN documents d ON d.doc_id = id WHERE rank <= 3 GROUP BY query_id",
    "doc_list_filtered": f"SELECT ord, id FROM {_STORE} WHERE metadata['mime_type'] = 'text/markdown' ORDER BY ord LIMIT 100",
    "doc_get_many": f"SELECT a.ord AS pos, a.id, md5(b.content) AS content_md5 FROM {_STORE} a JOIN {_STORE} b USING (id) WHERE a.ord % 100 = 0",
    "doc_upsert_latest": "SELECT workspace, arg_max(doc_id, (created_at, doc_id)) AS doc_id, min(doc_id) AS first_ord FROM documents GROUP BY workspace",
    "doc_delete": f"SELECT id, md5(content) AS content_md5 FROM {_STORE} WHERE id NOT IN (SELECT id FROM {_STORE} WHERE metadata['mime_type'] IS NULL)",
}
