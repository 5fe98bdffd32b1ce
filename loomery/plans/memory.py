"""Long-term memory over memory_store and the log memory_entries. The searches ask for all entries whose number is divisible by 100, in their own namespace."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import memory as M
from loomery.operators import ranking, vectors
from loomery.operators.bm25 import small
from loomery.plans.tables import entries, table
from loomery.plans.texts import ENTRIES, strip_sql
from loomery.session import checkpoint
from loomery.sources import stores

AS_OF = "2025-10-01 00:00:00"
LIMIT = 5


def _queries(spark, folder):
    rows = entries(spark, folder).where("ord % 100 = 0")
    return rows.select(F.col("ord").alias("query_id"), "namespace", F.lit(None).cast("string").alias("memory_type"), F.col("content").alias("query"), F.lit(LIMIT).alias("limit"), F.lit(0.5).alias("min_importance"))


def _out(ranked, *more):
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", *more)


def _lexical(spark, folder):
    return M.lexical_search(_queries(spark, folder), entries(spark, folder), AS_OF)


def _episodic(spark, folder):
    return M.episodic_search(_queries(spark, folder), entries(spark, folder), AS_OF)


def memory_rejected(spark, folder):
    return entries(spark, folder).groupBy("memory_type", M.accepted(entries(spark, folder)).alias("valid")).agg(F.count(F.lit(1)).alias("rows"))


def memory_latest(spark, folder):
    live = entries(spark, folder).where(M.is_active(AS_OF))
    newest = M.latest(live.select("namespace", "key", "id", "created_at", "ord"), ["namespace", "key"], ["created_at", "ord"])
    return newest.select(F.array_join("namespace", "/").alias("namespace"), "key", "id")


def memory_log_newest(spark, folder):
    log = table(spark, folder, "memory_entries").where("key IS NOT NULL").select("id", "namespace", "key", "memory_type", "invalidated_at", "created_at", "ord")
    return stores.newest_valid(log, ["namespace", "key"]).select("namespace", "key", "id")


def memory_active(spark, folder):
    rows = entries(spark, folder).where(M.is_active(AS_OF))
    return rows.groupBy("memory_type").agg(F.count(F.lit(1)).alias("active"), F.round(F.avg("importance"), 6).alias("importance"))


def memory_conflicts(spark, folder):
    rows = entries(spark, folder)
    return M.conflicts(rows, rows, AS_OF)


def memory_invalidate(spark, folder):
    rows = entries(spark, folder)
    out = M.invalidate(rows, rows.where("ord % 100 = 0"), AS_OF)
    return out.groupBy("memory_type").agg(F.count("invalidated_at").alias("closed"), F.count(F.lit(1)).alias("rows"))


def memory_fallback_search(spark, folder):
    return _out(M.fallback_search(_queries(spark, folder), entries(spark, folder)), F.round("score", 6).alias("score"))


def memory_lexical(spark, folder):
    return _out(_lexical(spark, folder), F.round("score", 6).alias("score"))


def memory_episodic(spark, folder):
    return _out(_episodic(spark, folder), F.round("score", 6).alias("score"))


def memory_hybrid_routed(spark, folder):
    asked, stored = _queries(spark, folder), M.searched(entries(spark, folder), AS_OF)
    fused = M.hybrid_search([M.lexical_search(asked, stored, AS_OF), M.episodic_search(asked, stored, AS_OF)], asked, {"*": [0, 1], "procedural": [0]})
    return _out(fused, F.round("fused", 9).alias("fused"))


def memory_multi_store(spark, folder):
    asked, stored = _queries(spark, folder), M.searched(entries(spark, folder), AS_OF)
    lists = M.episodic_search(asked, stored, AS_OF).select("query_id", F.lit(0).alias("list_no"), "rank", "id").unionByName(M.lexical_search(asked, stored, AS_OF).select("query_id", F.lit(1).alias("list_no"), "rank", "id"))
    return _out(ranking.first_wins(lists, LIMIT))


def memory_search_filtered(spark, folder):
    rule = M.MetadataFilter(equals={"source": "chat"}, created_after="2025-02-01 00:00:00", created_before="2025-09-01 00:00:00")
    ranked = checkpoint(_lexical(spark, folder).drop("importance"))
    hit = table(spark, folder, "memory_store").join(small(ranked.select("id").distinct()), "id", "left_semi").dropDuplicates(["ord"])  # only those are shuffled
    hits = M.with_filters(ranked, hit, _queries(spark, folder), rule)
    return _out(hits)


def memory_context(spark, folder):
    hits = _lexical(spark, folder).drop("importance", "ord").join(entries(spark, folder), "id")
    return M.context_lines(hits).select("query_id", F.md5("context").alias("context_md5"))


def memory_semantic_onehop(spark, folder):
    rows, asked = entries(spark, folder), _queries(spark, folder)
    stored = table(spark, folder, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector")).join(rows.select("id", "ord"), "ord")
    hits = vectors.search(stored.select("id", "ord", "vector"), stored.join(asked.select(F.col("query_id").alias("ord")), "ord").select(F.col("ord").alias("query_id"), "vector"), 10 * LIMIT)
    return _out(M.semantic_search(asked, hits.select("query_id", "rank", "id", "score"), rows, AS_OF), F.round("score", 6).alias("score"))


def memory_reverse_links(spark, folder):
    rows = entries(spark, folder)
    linked = M.reverse_links(rows, rows.select("id", "namespace", "related_ids", "invalidated_at", "expires_at"), AS_OF)
    return linked.select("id", F.array_join("related_ids", ",").alias("related"))


def memory_related(spark, folder):
    found = _lexical(spark, folder).join(entries(spark, folder).select(F.col("ord").alias("query_id"), F.col("id").alias("own")), "query_id").select(F.col("own").alias("id"), F.col("id").alias("other"), "rank")
    return M.related(entries(spark, folder).where("ord % 100 = 0"), found).select("id", F.array_join("related_ids", ",").alias("related"))


def memory_policy_filter(spark, folder):
    return M.NamespacePolicy(["user"]).visible(entries(spark, folder)).groupBy("memory_type").agg(F.count(F.lit(1)).alias("visible"))


def memory_metadata_filter(spark, folder):
    rule = M.MetadataFilter(equals={"extracted_by": "llm"}, created_after="2025-03-01 00:00:00")
    return entries(spark, folder).where(rule.condition()).select("id")


def reflection_sources(spark, folder):
    rows = M.reflection_sources(entries(spark, folder), 5)
    return rows.select(F.array_join("namespace", "/").alias("namespace"), "id", F.col("rank").cast("bigint").alias("rank"))


def reflection_points(spark, folder):
    return M.reflection_points(entries(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        memory_rejected, memory_latest, memory_log_newest, memory_active, memory_conflicts, memory_invalidate, memory_fallback_search, memory_lexical, memory_episodic, memory_hybrid_routed, memory_multi_store,
        memory_search_filtered, memory_context, memory_semantic_onehop, memory_reverse_links, memory_related, memory_policy_filter, memory_metadata_filter, reflection_sources, reflection_points,
    )
}

_TS = f"TIMESTAMP '{AS_OF}'"
_LIVE = f"invalidated_at IS NULL AND (expires_at IS NULL OR expires_at::TIMESTAMP > {_TS})"
_TEXT = f"array_to_string(list_filter([{strip_sql('x')} FOR x IN list_concat([array_to_string(namespace, ' '), memory_type, key, content], coalesce(map_values(metadata), []))], lambda y: y IS NOT NULL AND y <> ''), ' ')"
_BASE = f"""
e AS (SELECT *, {_TEXT} AS text FROM {ENTRIES}),
q AS (SELECT ord AS query_id, namespace AS qns, content AS query FROM e WHERE ord % 100 = 0),
cand AS (SELECT q.query_id, q.query, e.* FROM q JOIN e ON e.namespace[1:len(q.qns)] = q.qns WHERE {_LIVE})"""
_UNIT = "least(1e0, greatest(0e0, {x}))"
_BLEND = f"coalesce(0.7e0 * {_UNIT.format(x='{r}')} + 0.3e0 * {_UNIT.format(x='importance')} + CASE WHEN importance IS NOT NULL THEN 0e0 END, {_UNIT.format(x='{r}')})"
_LEX = (
    _BASE
    + rf""",
tok AS (SELECT query_id, id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS token FROM cand),
dl AS (SELECT c.query_id, c.id, coalesce(n, 0) AS dl FROM cand c LEFT JOIN (SELECT query_id, id, count(*) AS n FROM tok GROUP BY ALL) USING (query_id, id)),
st AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY query_id),
tf AS (SELECT query_id, id, token, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT query_id, token, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS token FROM q) GROUP BY ALL),
sc AS (SELECT query_id, id, sum(times * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
  FROM qt JOIN tf USING (query_id, token) JOIN df USING (query_id, token) JOIN dl USING (query_id, id) JOIN st USING (query_id) GROUP BY query_id, id),
rk AS (SELECT * FROM (SELECT query_id, id, ord, importance, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM sc JOIN cand USING (query_id, id) WHERE score > 0) WHERE rank <= {LIMIT}),
bare AS (SELECT * FROM (SELECT query_id, id, ord, importance, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM (
  SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0e0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS score FROM (
    SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM cand WHERE query_id NOT IN (SELECT query_id FROM sc WHERE score > 0)))
  WHERE score > 0) WHERE rank <= {LIMIT}),
lexical AS (SELECT query_id, rank, id, ord, score / max(score) OVER (PARTITION BY query_id) AS relevance, importance FROM rk UNION ALL SELECT query_id, rank, id, ord, score, importance FROM bare)"""
)
_EPI = rf"""
epi AS (SELECT * FROM (SELECT query_id, id, ord, importance, m, row_number() OVER (PARTITION BY query_id ORDER BY round(m, 9) DESC, ord) AS rank FROM (
  SELECT *, (CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0e0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END + exp(-0.01e0 * greatest(0e0, (epoch_us({_TS}) - epoch_us(created_at)) / 3.6e9))) / 2 AS m FROM (
    SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM cand WHERE memory_type = 'episodic'))) WHERE rank <= {LIMIT})"""
_FOLD = rf"regexp_replace({strip_sql('replace(lower(content), $$ß$$, $$ss$$)')}, '\s+', ' ', 'g')"
_MEAN = "m"
_REL = "relevance"

_FIRST_THREE = "list_filter(l, lambda x, i: list_position(l, x) = i)[1:3]"

ORACLE = {
    "memory_rejected": f"SELECT memory_type, len(coalesce(namespace, [])) > 0 AND coalesce({strip_sql('key')}, '') <> '' AND coalesce({strip_sql('content')}, '') <> '' AND (importance IS NULL OR importance BETWEEN 0 AND 1) AS valid, count(*) AS rows FROM {ENTRIES} GROUP BY ALL",
    "memory_latest": f"SELECT array_to_string(namespace, '/') AS namespace, key, arg_max(id, (created_at, ord)) AS id FROM {ENTRIES} WHERE {_LIVE} GROUP BY 1, 2",
    "memory_log_newest": "SELECT namespace, key, arg_max(id, (created_at, ord)) AS id FROM memory_entries WHERE key IS NOT NULL AND invalidated_at IS NULL AND created_at IS NOT NULL GROUP BY 1, 2",
    "memory_active": f"SELECT memory_type, count(*) AS active, round(avg(importance), 6) AS importance FROM {ENTRIES} WHERE {_LIVE} GROUP BY memory_type",
    "memory_conflicts": f"""WITH e AS (SELECT *, {_FOLD} AS fold, regexp_replace(trim(lower(coalesce(metadata['subject'], metadata['name']))), '\\s+', ' ', 'g') AS subject FROM {ENTRIES})
SELECT DISTINCT n.id AS new_id, o.id AS old_id FROM e n JOIN (SELECT * FROM e WHERE {_LIVE}) o ON n.namespace = o.namespace AND n.memory_type = o.memory_type AND n.id <> o.id AND n.fold <> o.fold
  AND (n.key = o.key OR (n.memory_type IN ('preference', 'entity') AND n.subject = o.subject))""",
    "memory_invalidate": f"""WITH e AS (SELECT * FROM {ENTRIES}), k AS (SELECT DISTINCT namespace, key FROM e WHERE ord % 100 = 0)
SELECT memory_type, count(*) FILTER (invalidated_at IS NOT NULL OR k.key IS NOT NULL) AS closed, count(*) AS rows FROM e LEFT JOIN k ON e.namespace = k.namespace AND e.key = k.key GROUP BY memory_type""",
    "memory_fallback_search": f"""WITH {_BASE} SELECT query_id, rank, id, score FROM (SELECT query_id, id, round(coalesce(importance, 0e0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(importance, 0e0), 9) DESC, ord) AS rank
FROM q JOIN e ON e.namespace = q.qns WHERE invalidated_at IS NULL AND (importance IS NULL OR importance >= 0.5)) WHERE rank <= {LIMIT}""",
    "memory_lexical": f"WITH {_LEX} SELECT query_id, rank, id, round({_BLEND.format(r=_REL)}, 6) AS score FROM lexical",
    "memory_episodic": f"WITH {_BASE}, {_EPI} SELECT query_id, rank, id, round({_BLEND.format(r=_MEAN)}, 6) AS score FROM epi",
    "memory_hybrid_routed": f"""WITH {_LEX}, {_EPI}, lists AS (SELECT query_id, 0 AS l, rank, id FROM lexical UNION ALL SELECT query_id, 1, rank, id FROM epi),
f AS (SELECT query_id, id, sum(1e0 / (60 + rank)) AS fused, min(l * 1000 + rank) AS first FROM lists GROUP BY ALL)
SELECT query_id, rank, id, round(fused, 9) AS fused FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, first, id) AS rank FROM f) WHERE rank <= {LIMIT}""",
    "memory_multi_store": f"""WITH {_LEX}, {_EPI}, lists AS (SELECT query_id, 0 AS l, rank AS r, id FROM epi UNION ALL SELECT query_id, 1, rank, id FROM lexical),
once AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY l, r) = 1)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY l, r) AS rank, id FROM once) WHERE rank <= {LIMIT}""",
    "memory_search_filtered": f"""WITH {_LEX} SELECT l.query_id, l.rank, l.id FROM lexical l JOIN e USING (id) WHERE (e.importance IS NULL OR e.importance >= 0.5) AND e.metadata['source'] = 'chat'
AND e.created_at::TIMESTAMP BETWEEN TIMESTAMP '2025-02-01' AND TIMESTAMP '2025-09-01'""",
    "memory_context": f"WITH {_LEX} SELECT l.query_id, md5(string_agg('- [' || e.memory_type || '] ' || e.key || ': ' || e.content, chr(10) ORDER BY l.rank)) AS context_md5 FROM lexical l JOIN e USING (id) GROUP BY l.query_id",
    "memory_reverse_links": f"""WITH e AS (SELECT * FROM {ENTRIES}),
links AS (SELECT DISTINCT n.id AS from_id, n.namespace, n.ord, unnest(n.related_ids) AS id FROM e n),
firsts AS (SELECT id, namespace, list(from_id ORDER BY r) AS before FROM (SELECT *, row_number() OVER (PARTITION BY id, namespace ORDER BY ord DESC, from_id) AS r FROM links WHERE from_id <> id) WHERE r <= 3 GROUP BY ALL),
merged AS (SELECT o.id, list_concat(before, coalesce(related_ids, [])) AS l FROM (SELECT * FROM e WHERE {_LIVE}) o JOIN firsts f ON f.id = o.id AND f.namespace = o.namespace)
SELECT id, array_to_string({_FIRST_THREE}, ',') AS related FROM merged""",
    "memory_related": f"""WITH {_LEX}, found AS (SELECT query_id, list(id ORDER BY rank) AS more FROM lexical GROUP BY query_id),
merged AS (SELECT e.id, list_filter(list_concat(coalesce(e.related_ids, []), coalesce(more, [])), lambda x: x <> e.id) AS l FROM e LEFT JOIN found ON query_id = e.ord WHERE e.ord % 100 = 0)
SELECT id, array_to_string({_FIRST_THREE}, ',') AS related FROM merged""",
    "memory_semantic_onehop": f"""WITH {_BASE}, v AS (SELECT e.ord, e.id, embedding::DOUBLE[] AS x FROM embeddings JOIN e ON vec_id = e.ord),
near AS (SELECT * FROM (SELECT q.ord AS query_id, s.id, list_cosine_similarity(q.x, s.x) AS sim, row_number() OVER (PARTITION BY q.ord ORDER BY round(list_cosine_similarity(q.x, s.x), 9) DESC, s.ord) AS rank FROM v q, v s WHERE q.ord % 100 = 0) WHERE rank <= {10 * LIMIT}),
direct AS (SELECT query_id, near.rank, id, ord, sim AS r, importance, related_ids, 0 AS hop FROM near JOIN cand USING (query_id, id) WHERE sim > 0),
linked AS (SELECT l.query_id, l.rank, c.id, c.ord, 0.9e0 * l.r AS r, c.importance, c.related_ids, 1 AS hop FROM (SELECT query_id, rank, r, unnest(related_ids) AS to_id FROM direct) l JOIN cand c ON c.query_id = l.query_id AND c.id = l.to_id),
both_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank, hop) AS seen FROM (SELECT * FROM direct UNION ALL SELECT * FROM linked)),
kept AS (SELECT *, coalesce(sum(CASE WHEN seen = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM both_),
one AS (SELECT query_id, id, ord, {_BLEND.format(r="r")} AS score FROM kept WHERE before < {LIMIT} QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY hop, rank) = 1)
SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM one) WHERE rank <= {LIMIT}""",
    "memory_policy_filter": f"SELECT memory_type, count(*) AS visible FROM {ENTRIES} WHERE namespace[1] = 'user' GROUP BY memory_type",
    "memory_metadata_filter": f"SELECT id FROM {ENTRIES} WHERE metadata['extracted_by'] = 'llm' AND created_at::TIMESTAMP >= TIMESTAMP '2025-03-01'",
    "reflection_sources": f"""SELECT namespace, id, rank FROM (SELECT array_to_string(namespace, '/') AS namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY coalesce(importance, 0e0) DESC, created_at DESC, ord) AS rank
FROM {ENTRIES} WHERE coalesce(metadata['source'], '') <> 'reflection' AND invalidated_at IS NULL) WHERE rank <= 5""",
}
