"""p6: documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.packing import pack
from loomery.llm.tokens import token_count
from loomery.plans.tables import table

CAPACITY = 2048


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    sized = table(spark, folder, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))
    out = pack(sized, "doc_id", "tokens", CAPACITY)
    return out.select("doc_id", "piece_no", F.col("start").alias("start_token"), F.col("size").alias("tokens"), "container")


QUERIES = {"p6_containers": p6_containers}
ORACLE: dict[str, str] = {}
