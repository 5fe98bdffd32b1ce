"""Stores as logs: documents, vectors and sessions with upsert, lookup, listing and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(log: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The last version of each key, at the place of its first: ``ord`` is the least of the key."""
    columns = [c for c in log.columns if c != "ord"]
    last = F.max_by(F.struct(*columns), F.struct(*version)).alias("row")
    return log.groupBy(F.col(key).alias("__k")).agg(last, F.min("ord").alias("ord")).select("row.*", "ord")


def identified(docs: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """Missing ids from the content and ``ord``: the same on every run."""
    return docs.withColumn(id, F.coalesce(id, F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws(":", F.col("ord").cast("string"), content), 256), 1, 32))))


def listed(docs: DataFrame, filters: dict[str, str | None], limit: int = 100) -> DataFrame:
    """Documents that equal all filters, in order. ``id`` is the document's own; other names are of the metadata, where an
    absent name equals None."""
    condition: Column = F.lit(True)
    for name, value in filters.items():
        have = F.col("id") if name == "id" else F.try_element_at("metadata", F.lit(name))
        condition = condition & have.eqNullSafe(F.lit(value).cast("string"))
    return docs.where(condition).orderBy("ord").limit(limit)


def fetched(docs: DataFrame, wanted: DataFrame, id: str = "id") -> DataFrame:
    """The documents of ``wanted`` (id, pos), once for each time they are asked for; ``pos`` gives the order."""
    return wanted.join(docs, id)


def deleted(docs: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return docs.join(ids.select(id), id, "left_anti")


def newest_valid(log: DataFrame, keys: list[str]) -> DataFrame:
    """The newest entry of each key that is not invalidated."""
    rows = log.where("invalidated_at IS NULL AND created_at IS NOT NULL")
    newest = F.max_by(F.struct(*log.columns), F.struct("created_at", "ord")).alias("row")
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(newest).select("row.*")


def save_session(messages: DataFrame, path: str) -> None:
    """Replace the sessions that occur in ``messages``, leave the others as they are."""
    messages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def load_session(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.where(F.col("session_id") == session_id).orderBy("pos")


def once(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One row for each key: redelivered rows count once."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("__n = 1").drop("__n")
