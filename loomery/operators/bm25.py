"""BM25 over an inverted index: postings, document lengths and frequencies are DataFrames that can be written and reused.

A query only meets the postings of its own words, or, for the ``k`` best, streams of documents (``blocks``). Repeated query
words count each time: they are grouped to a multiplicity first. The index may be split by a group column, so that each group has its own statistics.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.errors import ConfigurationError
from loomery.functions import text as T
from loomery.operators import blocks
from loomery.operators.ranking import top_k


@dataclass
class Index:
    postings: DataFrame  # group, token, id, ord, tf, dl
    frequencies: DataFrame  # group, token, df
    stats: DataFrame  # group, n, avgdl
    k1: float = 1.5
    b: float = 0.75
    documents: DataFrame | None = None  # group, id, ord, *more, tokens, dl
    more: tuple[str, ...] = ()


def build(docs: DataFrame, id: str, text: str, ord: str | None = None, group: str | None = None, k1: float = 1.5, b: float = 0.75, tokenizer: Callable[[Column], Column] = T.words, more: tuple[str, ...] = ()) -> Index:
    """Index ``docs``. Null and empty texts are documents of length 0: they count in the statistics and match nothing.
    An id is one document of its group; ``more`` names columns that come out with the hits."""
    if k1 <= 0:
        raise ConfigurationError("k1 must be positive", parameter="k1", value=k1)
    if not 0 <= b <= 1:
        raise ConfigurationError("b must be in [0, 1]", parameter="b", value=b)
    rows = docs.select(F.col(group).alias("group") if group else F.lit(0).alias("group"), F.col(id).alias("id"), F.col(ord or id).alias("ord"), *more, F.coalesce(tokenizer(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    rows = rows.withColumn("dl", F.size("tokens"))
    stats = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    # a document's tokens are in one partition, so the partial aggregate already has each posting once
    counted = rows.select("group", "id", "ord", "dl", F.explode("tokens").alias("token")).groupBy("group", "id", "ord", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    frequencies = rows.select("group", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("group", "token").agg(F.count(F.lit(1)).alias("df"))
    return Index(counted, frequencies, stats, k1, b, rows, more)


def query_terms(queries: DataFrame, id: str, text: str, group: str | None = None, tokenizer: Callable[[Column], Column] = T.words) -> DataFrame:
    asked = queries.select(F.col(id).alias("query_id"), F.col(group).alias("group") if group else F.lit(0).alias("group"), F.explode(tokenizer(F.col(text))).alias("token"))
    return asked.groupBy("query_id", "group", "token").agg(F.count(F.lit(1)).alias("times"))


#: So many rows are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 100_000


def small(rows: DataFrame) -> DataFrame:
    """To be broadcast if there are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def asked_only(part: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of the words that are asked for. The semi join goes below the aggregates, so of a document that is not
    indexed yet only those words are counted and shuffled; stop words that nobody asks for are no hot keys."""
    return part.join(small(asked.select("group", "token").distinct()), ["group", "token"], "left_semi")


def _weights(index: Index, asked: DataFrame) -> DataFrame:
    weights = asked.join(asked_only(index.frequencies, asked), ["group", "token"]).join(F.broadcast(index.stats) if _one_group(index) else index.stats, "group")
    idf = F.log1p((F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    return weights.select("query_id", "group", "token", (idf * F.col("times")).alias("w"), "avgdl")


def scores(index: Index, asked: DataFrame) -> DataFrame:
    """``query_id, id, ord, score`` for every document with a word of the query: as many rows as there are such pairs."""
    met = asked_only(index.postings, asked).join(_weights(index, asked), ["group", "token"])
    tf, k1, b = F.col("tf").cast("double"), F.lit(float(index.k1)), F.lit(float(index.b))
    part = F.col("w") * tf * (k1 + 1) / (tf + k1 * (F.lit(1.0) - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "id", "ord").agg(F.sum(part).alias("score"))


def best(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, id, ord, *more, score, rank`` of the ``k`` best documents of each query of ``query_terms``, from an index
    that has the documents: no pair of query and document is a row."""
    k1, b = float(index.k1), float(index.b)

    def part(tf, docs, doc, avgdl):
        dl = docs["dl"].to_numpy()[doc]
        return tf * (k1 + 1) / (tf + k1 * (1.0 - b + b * dl / avgdl))

    weights = _weights(index, asked).select("query_id", "group", F.col("avgdl").alias("mean"), F.lit(1.0).alias("scale"), "token", "w")
    return blocks.best(index.documents, weights, asked.count(), k, part, lambda sums, scale, docs, doc: sums, list(index.more)).drop("sum")


def _one_group(index: Index) -> bool:
    return "group" in index.stats.columns and index.stats.schema["group"].dataType.simpleString() == "int"


def search(index: Index, queries: DataFrame, id: str, text: str, k: int | Column, group: str | None = None, tokenizer: Callable[[Column], Column] = T.words) -> DataFrame:
    """``query_id, id, ord, score, rank`` of the ``k`` best documents with a positive score."""
    asked = query_terms(queries, id, text, group, tokenizer)
    if isinstance(k, int) and index.documents is not None:
        return best(index, asked, k)
    return top_k(scores(index, asked).where("score > 0"), ["query_id"], "score", k, ["ord"])
