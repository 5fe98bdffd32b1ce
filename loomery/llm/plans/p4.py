"""p4: oversized documents as pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomery.llm.splitting import split_oversized
from loomery.plans.tables import table


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "doc_store").select("id", "content", "ord").dropDuplicates(["ord"])
    return split_oversized(docs, "content").select("id", "piece_no", "start_pos", "piece", "cut", "forced")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "doc_store").select("id", "content")
    return split_oversized(docs, "content").select("id", "forced").distinct()


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}

_SPACE = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ORACLE = {
    "p4_found": rf"""
SELECT DISTINCT id, CASE WHEN regexp_matches(t, '[^{_SPACE}]{{1000}}[^{_SPACE}]') THEN 1 ELSE 0 END::INTEGER AS forced
FROM (SELECT id, regexp_replace(content, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS t FROM doc_store)
WHERE length(t) > 1000
"""
}
