"""Top-k, fusion, query variants and reranking over whole batches of queries.

A ranked list has ``query_id, list_no, rank, id, ord, score``. Ties are broken by ``ord``; scores are ordered as rounded
to nine places, so the last bits of a sum never decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.errors import ConfigurationError


def top_k(scored: DataFrame, by: list[str], score: str, k: int | Column, ties: list[str]) -> DataFrame:
    """The ``k`` best rows of each group with their ``rank`` from 1; ``k`` may be a column."""
    order = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), *ties)
    limit = F.lit(k) if isinstance(k, int) else k
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fuse(lists: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: ``query_id, id, fused, list_no, score, rank``. ``list_no`` and ``score`` are those of the
    best-scored occurrence, ties of the sum go to the first appearance (least list, then rank)."""
    best = F.max_by(F.struct("list_no", "score"), F.struct(F.col("score"), -F.col("list_no"), -F.col("rank")))
    fused = lists.groupBy("query_id", "id").agg(
        F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("fused"), F.min(F.struct("list_no", "rank")).alias("first"), best.alias("best")
    )
    order = Window.partitionBy("query_id").orderBy(F.round("fused", 12).desc(), "first", "id")
    out = fused.select("query_id", "id", "fused", "best.list_no", "best.score", F.row_number().over(order).alias("rank"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def fetch_size(limit: int) -> int:
    """How many hits a fusion asks of each list."""
    return max(4 * limit, 10)


def first_wins(lists: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """Lists one after the other, each id where it comes first, cut to ``limit`` a query."""
    once = lists.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("list_no", "rank"))).where("__n = 1").drop("__n")
    out = once.withColumnRenamed("rank", "list_rank")
    order = Window.partitionBy("query_id").orderBy("list_no", "list_rank")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def variants(queries: DataFrame, rewriter: Callable[[str], str], most: int = 3) -> DataFrame:
    """``query_id, list_no, text``: rewrites, one in a line of the rewriter's reply, at most ``most``, then the original;
    equal texts once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q, text in zip(pdf["query_id"], pdf["text"]):
                lines = [line.strip().removeprefix("-").strip() for line in rewriter(text or "").splitlines()]
                kept = list(dict.fromkeys([*[line for line in lines if line][:most], text]))
                rows += [(q, i, v) for i, v in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["query_id", "list_no", "text"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "text").mapInPandas(run, f"query_id {kind}, list_no int, text string")


def rerank(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], top_n: int = 3, max_chars: int = 1200, batch: int = 16, name: str = "scorer") -> DataFrame:
    """Score (query, content) pairs anew and keep the ``top_n`` of each query. ``pairs`` has ``query_id, query, id, ord,
    content``; contents are scored up to ``max_chars``, which is a parameter of the operation."""
    if top_n < 1 or max_chars < 1 or batch < 1:
        raise ConfigurationError("top_n, max_chars and batch must be positive", top_n=top_n, max_chars=max_chars, batch=batch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores: list[float] = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                scores += scorer(part["query"].fillna("").tolist(), part["content"].fillna("").str[:max_chars].tolist())
            yield pdf.assign(score=[float(s) for s in scores], reranker=name)

    kept = pairs.select("query_id", "query", "id", "ord", "content")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return top_k(kept.mapInPandas(run, f"{fields}, score double, reranker string"), ["query_id"], "score", top_n, ["ord"])


def overlap_scorer(queries: list[str], contents: list[str]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: the share of query words in the content."""
    out = []
    for q, c in zip(queries, contents):
        asked, there = set(q.lower().split()), set(c.lower().split())
        out.append(len(asked & there) / len(asked) if asked else 0.0)
    return out


def prompt(hits: DataFrame, content: str = "content") -> DataFrame:
    """``query_id, context``: the hits of a query as numbered passages in the order of their rank."""
    lines = F.array_sort(F.collect_list(F.struct("rank", F.col(content).alias("line"))))
    numbered = F.transform(lines, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["line"]))
    return hits.groupBy("query_id").agg(F.array_join(numbered, "\n\n").alias("context"))
