"""Text functions and chunks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import splitters as S
from loomery.operators import windows as W
from loomery.plans.tables import entries, messages, table

MOST_CHARS = 60


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "source")


def _hashed(tokens):
    return [F.md5(F.array_join(tokens, " ")).alias("tokens_md5"), F.size(tokens).cast("bigint").alias("tokens"), F.size(F.array_distinct(tokens)).cast("bigint").alias("distinct_tokens")]


def tokenize_word(spark, folder):
    return _documents(spark, folder).select("doc_id", *_hashed(T.words(F.col("text"))))


def tokenize_ascii(spark, folder):
    return _documents(spark, folder).select("doc_id", *_hashed(T.terms(F.col("text"))))


def token_overlap(spark, folder):
    cases = table(spark, folder, "eval_cases").where("reference IS NOT NULL").select("id", "question", "reference").distinct()
    return cases.select("id", F.round(T.overlap(F.col("question"), F.col("reference")), 6).alias("score"))


def token_estimate(spark, folder):
    return messages(spark, folder).select("ord", T.token_estimate(F.col("content"), W.tool_chars()).cast("bigint").alias("tokens"))


def searchable_text(spark, folder):
    text = T.searchable(F.col("namespace"), F.col("memory_type"), F.col("key"), F.col("content"), F.col("metadata"))
    return entries(spark, folder).select("ord", F.md5(text).alias("text_md5"), F.length(text).cast("bigint").alias("chars"))


def tool_result_truncation(spark, folder):
    short = T.truncated_result(F.col("content"), F.col("role"), MOST_CHARS)
    return messages(spark, folder).where("role = 'tool'").select("ord", F.md5(short).alias("content_md5"), F.length(short).cast("bigint").alias("chars"))


def json_results(spark, folder):
    found = T.json_object(F.col("content"))
    rows = messages(spark, folder).where("role = 'tool'").select("ord", F.try_variant_get(found, "$.ref", "string").alias("ref"), F.try_variant_get(found, "$.count", "bigint").alias("count"))
    return rows.where("ref IS NOT NULL")


def session_names(spark, folder):
    return table(spark, folder, "messages").select("session_id").distinct().select("session_id", T.safe_name(F.col("session_id")).alias("file"))


def _chunks(df, key):
    return df.select(F.col(key), "chunk_index", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("bigint").alias("chars"))


def chunk_fixed(spark, folder):
    return _chunks(S.fixed(_documents(spark, folder), "doc_id", "text"), "doc_id")


def chunk_parent_child(spark, folder):
    _, children = S.parent_child(_documents(spark, folder), "doc_id", "text")
    return _chunks(children, "parent_id")


def chunk_recursive_char(spark, folder):
    return _chunks(S.recursive_character(_documents(spark, folder), "doc_id", "text"), "doc_id")


def chunk_recursive_text(spark, folder):
    return _chunks(S.recursive_text(_documents(spark, folder), "doc_id", "text"), "doc_id")


def chunk_markdown(spark, folder):
    return S.markdown(_documents(spark, folder), "doc_id", "text").select("doc_id", "chunk_index", F.array_join("heading_path", " > ").alias("path"), F.md5("chunk").alias("chunk_md5"))


def _pages(spark, folder):
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><body><div><h1>"), F.coalesce("source", F.lit("none")), F.lit("</h1><script>var t='</p>';</script><p>"), escaped, F.lit("</p></div></body></html>"))
    return _documents(spark, folder).select("doc_id", page.alias("html"))


def html_to_text(spark, folder):
    return _pages(spark, folder).select("doc_id", F.md5(S.html_to_text(F.col("html"))).alias("text_md5"))


def chunk_html(spark, folder):
    return S.html(_pages(spark, folder), "doc_id", "html").select("doc_id", "chunk_index", "tag", F.array_join("heading_path", " > ").alias("path"), F.md5("chunk").alias("chunk_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_word, tokenize_ascii, token_overlap, token_estimate, searchable_text, tool_result_truncation, json_results, session_names,
        chunk_fixed, chunk_parent_child, chunk_recursive_char, chunk_recursive_text, chunk_markdown, html_to_text, chunk_html,
    )
}

_S = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{_S}]+', ''), '[{_S}]+$', '')"


MESSAGES = "(SELECT DISTINCT session_id, pos, role, content, tool_calls, pinned, kind, ord, id FROM messages)"
ENTRIES = "(SELECT * FROM memory_store QUALIFY row_number() OVER (PARTITION BY ord ORDER BY loaded_at) = 1)"


def _token_sql(pattern: str) -> str:
    return f"""SELECT doc_id, md5(array_to_string(t, ' ')) AS tokens_md5, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{pattern}') AS t FROM documents)"""


def _window_sql(source: str, key: str, text: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS chunk_index, c AS chunk FROM (
  SELECT {key}, i, {strip_sql(f"substring({text}, CAST(i * {step} + 1 AS BIGINT), {size})")} AS c
  FROM (SELECT {key}, {text}, unnest(range(0, 1 + greatest(0, CAST(ceil((length({text}) - {size}) / {step}.0) AS BIGINT)))) AS i FROM {source})
) WHERE c <> ''"""


_FIXED = _window_sql("documents", "doc_id", "text", 500, 50)
_PARENTS = _window_sql("documents", "doc_id", "text", 500, 0)
_CHILDREN = _window_sql(f"(SELECT doc_id || '_chunk_' || chunk_index AS parent_id, chunk AS parent_text FROM ({_PARENTS}))", "parent_id", "parent_text", 200, 20)

ORACLE = {
    "tokenize_word": _token_sql(r"[\p{L}\p{N}_]+"),
    "tokenize_ascii": _token_sql("[a-z0-9]+"),
    "token_overlap": """SELECT id, round(CASE WHEN len(q) = 0 OR len(c) = 0 THEN 0e0 ELSE len(list_intersect(q, c))::DOUBLE / len(q) END, 6) AS score FROM (
  SELECT id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(reference), '[a-z0-9]+')) AS c
  FROM (SELECT DISTINCT id, question, reference FROM eval_cases WHERE reference IS NOT NULL))""",
    "token_estimate": f"""SELECT ord, 4 + CAST(ceil((coalesce(length(content), 0) + coalesce(list_sum([coalesce(length(x.name), 0) + coalesce(length(x.input), 0) FOR x IN tool_calls]), 0)) / 4e0) AS BIGINT) AS tokens FROM {MESSAGES}""",
    "searchable_text": f"""SELECT ord, md5(t) AS text_md5, length(t) AS chars FROM (
  SELECT ord, array_to_string(list_filter([{strip_sql('x')} FOR x IN list_concat([array_to_string(namespace, ' '), memory_type, key, content], coalesce(map_values(metadata), []))], lambda y: y IS NOT NULL AND y <> ''), ' ') AS t FROM {ENTRIES})""",
    "tool_result_truncation": rf"""SELECT ord, md5(t) AS content_md5, length(t) AS chars FROM (SELECT ord, CASE WHEN length(content) > {MOST_CHARS} THEN
  regexp_replace(substring(content, 1, {MOST_CHARS // 2}), '[{_S}]+$', '') || chr(10) || '...[' || (length(content) - {MOST_CHARS}) || ' characters truncated]...' || chr(10) || regexp_replace(right(content, {MOST_CHARS - MOST_CHARS // 2}), '^[{_S}]+', '')
  ELSE content END AS t FROM {MESSAGES} WHERE role = 'tool')""",
    "json_results": rf"""SELECT ord, json_extract_string(j, '$.ref') AS ref, TRY_CAST(json_extract_string(j, '$.count') AS BIGINT) AS count FROM (
  SELECT ord, CASE WHEN json_valid(content) THEN content WHEN json_valid(regexp_extract(content, '(?s)\{{.*\}}')) THEN regexp_extract(content, '(?s)\{{.*\}}') END AS j FROM {MESSAGES} WHERE role = 'tool')
  WHERE json_extract_string(j, '$.ref') IS NOT NULL""",
    "session_names": r"SELECT DISTINCT session_id, regexp_replace(session_id, '[^\p{L}\p{N}\-_.]', '_', 'g') AS file FROM messages",
    "chunk_fixed": f"SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5, length(chunk) AS chars FROM ({_FIXED})",
    "chunk_parent_child": f"SELECT parent_id, chunk_index, md5(chunk) AS chunk_md5, length(chunk) AS chars FROM ({_CHILDREN})",
}
