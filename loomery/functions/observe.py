"""Counters of the stages of a pipeline, taken while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, stage: str, counter: str) -> tuple[DataFrame, Observation]:
    """``df`` with an observation of its number of rows, such as (splitter.split, chunk_count)."""
    watch = Observation(stage)
    return df.observe(watch, F.count(F.lit(1)).alias(counter)), watch
