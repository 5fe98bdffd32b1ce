"""p5: personal information in messages and memory entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.pii import Field, background, details, redact, train
from loomery.plans.tables import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, name).select(F.lit(name).alias("src"), "ord", "content") for name in ("messages", "memory_store")]
    return parts[0].unionByName(parts[1])


def _field(spark: SparkSession, folder: str) -> Field:
    return train(background=background(table(spark, folder, "documents"), "text", "doc_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = details(_texts(spark, folder), "content", _field(spark, folder)).select("src", "ord", F.inline("pii"))
    return found.select("src", "ord", "pii_type", F.col("start_pos").cast("bigint").alias("start_pos")).distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    out = redact(_texts(spark, folder), "content", _field(spark, folder))
    return out.select("src", "ord", "redacted", F.size("pii").alias("details")).distinct()


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
ORACLE: dict[str, str] = {}
