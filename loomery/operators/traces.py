"""Traces of runs: metrics, tool statistics, stop reasons, retry schedules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def run_metrics(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, errors, distinct tools and time of each run; ``calls`` has ``tool, status, duration``."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tool_calls"),
        F.sum((F.col("status") == "error").cast("bigint")).alias("errors"),
        F.count_distinct("tool").alias("tools"),
        F.sum("duration").alias("total_ms"),
    )


def tool_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum((F.col("status") == "error").cast("bigint")).alias("errors"), F.avg("duration").alias("avg_ms"))


@dataclass
class Limits:
    steps: int | None = None
    model_calls: int | None = None
    tool_calls: int | None = None
    seconds: float | None = None
    tokens: int | None = None


def stop_reason(limits: Limits) -> Column:
    """The first limit that a run with ``steps, model_calls, tool_calls, seconds, tokens`` has reached, in this order;
    time must be exceeded."""
    out = F.lit(None).cast("string")
    for name in ("tokens", "seconds", "tool_calls", "model_calls", "steps"):
        most = getattr(limits, name)
        if most is not None and (most or name != "tokens"):
            met = F.col(name) > most if name == "seconds" else F.col(name) >= most
            out = F.when(met, f"max_{'runtime' if name == 'seconds' else name}").otherwise(out)
    return out


def retry_schedule(spark: SparkSession, attempts: int = 6, base: float = 0.25, factor: float = 2.0, most: float = 2.0, jitter: float = 0.125) -> DataFrame:
    """``attempt, delay, least, most``: the wait before each attempt after the first, without and with jitter."""
    rows = spark.range(1, attempts).select(F.col("id").alias("attempt"), F.least(F.lit(most), F.lit(base) * F.pow(F.lit(factor), F.col("id") - 1)).alias("delay"))
    return rows.select("attempt", "delay", (F.col("delay") * (1 - jitter)).alias("least"), (F.col("delay") * (1 + jitter)).alias("most"))


def exchanges(messages: DataFrame) -> DataFrame:
    """Consecutive tool rows of a session as one: ``session_id, first_pos, role, rows, content``, as providers expect them."""
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy("pos")
    fresh = ~((F.col("role") == "tool") & F.coalesce(F.lag("role").over(order) == "tool", F.lit(False)))
    rows = messages.withColumn("__g", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"])
    return rows.groupBy("session_id", "__g", "role").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("rows"), F.array_join(lines, "\n").alias("content")).drop("__g")
