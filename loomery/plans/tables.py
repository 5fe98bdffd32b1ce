"""Reading the tables of a data folder, redelivered rows once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages").dropDuplicates(["ord"])


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "memory_store").dropDuplicates(["ord"])
