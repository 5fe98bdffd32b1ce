"""Exact vector search: blocks of vectors against blocks of queries, as matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.ranking import top_k

QUERY_BLOCK = 512
PART_ROWS = 20_000


def _unit(column: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    out, norms = np.zeros((len(column), size)), np.zeros(len(column))
    for i, v in enumerate(column):
        v = np.asarray([] if v is None else v, float)
        norms[i] = np.sqrt((v * v).sum())
        out[i, : min(size, len(v))] = v[:size]
    return out, norms


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, ord, score, rank``: the ``k`` vectors of the greatest cosine for each query, all vectors seen.

    ``vectors`` has ``id, ord, vector``, ``queries`` ``query_id, vector``. The queries are cut into blocks, the vectors
    into parts of some ``PART_ROWS``; each task holds one block of queries and streams one part of the vectors past it, keeping the ``k``
    best for each query. What is shuffled is the vectors once for each block of queries, and k rows for each pair of block and part.
    A null or zero vector has cosine 0 with everything.
    """
    if k <= 0:
        return top_k(vectors.crossJoin(queries.limit(0)).select("query_id", "id", "ord", F.lit(0.0).alias("score")), ["query_id"], "score", 0, ["ord"])
    numbered = queries.where("query_id IS NOT NULL").select("query_id", F.col("vector").alias("asked"))
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    parts = max(8, -(-vectors.count() // PART_ROWS))
    asked = numbered.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query_id", "asked")
    stored = vectors.withColumn("part", F.pmod(F.xxhash64("id", "ord"), F.lit(parts)).cast("int"))
    stored = stored.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", "id", "ord", "vector")

    def best(stored_pdf: pd.DataFrame, asked_pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(stored_pdf) or not len(asked_pdf):
            return pd.DataFrame({"query_id": asked_pdf["query_id"][:0], "id": stored_pdf["id"][:0], "ord": stored_pdf["ord"][:0], "score": np.zeros(0)})
        size = max(max((len(v) for v in asked_pdf["asked"] if v is not None), default=1), 1)
        v, vn = _unit(stored_pdf["vector"], size)
        q, qn = _unit(asked_pdf["asked"], size)
        cos = q @ v.T / np.where((n := qn[:, None] * vn[None, :]) == 0, np.inf, n)
        order = stored_pdf["ord"].to_numpy()
        rows = []
        for i in range(len(q)):
            top = np.lexsort((order, -np.round(cos[i], 9)))[:k]
            rows.append(pd.DataFrame({"query_id": asked_pdf["query_id"].iloc[i], "id": stored_pdf["id"].to_numpy()[top], "ord": order[top], "score": cos[i][top]}))
        return pd.concat(rows)

    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema.fields, *queries.schema.fields]}
    near = stored.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(best, f"query_id {kinds['query_id']}, id {kinds['id']}, ord {kinds['ord']}, score double")
    return top_k(near, ["query_id"], "score", k, ["ord"])


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """Add ``vector``: the embedding of each text, asked for in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, out = pdf[text].fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                out += embedder(texts[at : at + batch])
            yield pdf.assign(vector=out)

    df = df.select(*[c for c in df.columns if c != "vector"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, vector array<double>")


def hash_embedder(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding model: signed counts of hashed words."""

    def run(texts: list[str]) -> list[list[float]]:
        from zlib import crc32

        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = crc32(w.encode())
                v[h % size] += 1.0 if h & 0x10000 else -1.0
            out.append(v)
        return out

    return run


def without(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete by id."""
    return vectors.join(ids.select(F.col("id")), "id", "left_anti")
