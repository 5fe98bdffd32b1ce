"""p7: a mix of documents with the shares of mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.mixing import Mix, mix, report, temperature_mix
from loomery.llm.tokens import token_count
from loomery.plans.tables import table


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_key"), token_count(F.col("text")).alias("size"))


def _shares(spark: SparkSession, folder: str, made: Mix) -> DataFrame:
    rows = [(k, w) for k, w in made.weights.items()]
    weights = spark.createDataFrame(rows, "source string, weight double")
    return report(made.items, table(spark, folder, "mix_targets")).join(weights, "source", "left").withColumns({"exponent": F.lit(made.exponent), "total": F.lit(made.total)})


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """As many tokens as the different texts have, with the shares of the targets."""
    return mix(_items(spark, folder), table(spark, folder, "mix_targets")).items.withColumnRenamed("size", "tokens")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder, mix(_items(spark, folder), table(spark, folder, "mix_targets")))


def p7_temperature(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of a mix at the temperature at which the entropy is that of the targets."""
    return _shares(spark, folder, temperature_mix(_items(spark, folder), table(spark, folder, "mix_targets")))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_temperature": p7_temperature}
ORACLE: dict[str, str] = {}
