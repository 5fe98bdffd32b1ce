"""Conversation windows: the part of each session that a model sees, by messages or tokens.

A tool exchange is a unit: an assistant row with tool calls takes the tool rows right after it. System and pinned rows are
always kept. Windows run over (session, position); a session is sorted with spill, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.errors import ConfigurationError
from loomery.functions import text as T


def preserved() -> Column:
    return F.coalesce((F.col("role") == "system") | F.col("pinned"), F.lit(False))


def calls_tools() -> Column:
    return F.coalesce((F.col("role") == "assistant") & (F.size("tool_calls") > 0), F.lit(False))


def tool_chars() -> Column:
    return F.aggregate(F.coalesce("tool_calls", F.array().cast("array<struct<tool_use_id:string,name:string,input:string>>")), F.lit(0), lambda n, c: n + F.coalesce(F.length(c["name"]), F.lit(0)) + F.coalesce(F.length(c["input"]), F.lit(0)))


def units(messages: DataFrame) -> DataFrame:
    """Add ``keep_always`` and ``unit``: the number of the unit within the session, among the rows not kept always."""
    rows = messages.withColumn("keep_always", preserved())
    run = Window.partitionBy("session_id", "keep_always").orderBy("pos")
    caller = F.last(F.when(F.col("role") != "tool", calls_tools()), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))
    starts = ~((F.col("role") == "tool") & F.coalesce(caller, F.lit(False)))
    return rows.withColumn("__starts", starts.cast("int")).withColumn("unit", F.sum("__starts").over(run.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def _newest(rows: DataFrame, cost: str) -> DataFrame:
    """Add ``running``: the cost of the unit and all newer ones, and ``newest_unit``."""
    back = Window.partitionBy("session_id", "keep_always").orderBy(F.col("unit").desc()).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("session_id", "keep_always")
    return rows.withColumn("running", F.sum(cost).over(back)).withColumn("newest_unit", F.max("unit").over(whole))


def validate(max_messages: int | None, max_tokens: int | None) -> None:
    if (max_messages is None) == (max_tokens is None):
        raise ConfigurationError("give either max_messages or max_tokens")
    if (max_messages if max_messages is not None else max_tokens) <= 0:
        raise ConfigurationError("limits must be positive", max_messages=max_messages, max_tokens=max_tokens)


def by_messages(messages: DataFrame, max_messages: int, max_tool_chars: int | None = None) -> DataFrame:
    """The rows kept: those kept always, and whole newest units while their rows are within ``max_messages``; the newest
    unit is kept in any case."""
    validate(max_messages, None)
    rows = _newest(units(_shortened(messages, max_tool_chars)).withColumn("__one", F.lit(1)), "__one")
    return rows.where(F.col("keep_always") | (F.col("running") <= max_messages) | (F.col("unit") == F.col("newest_unit"))).drop("__one", "running", "newest_unit")


def by_tokens(messages: DataFrame, max_tokens: int, max_tool_chars: int | None = None) -> DataFrame:
    """As ``by_messages``, within a budget of tokens from which the rows kept always are paid first. ``status`` is ok,
    preserved_over_budget or newest_over_budget; a session that is not ok keeps nothing else."""
    validate(None, max_tokens)
    rows = units(_shortened(messages, max_tool_chars)).withColumn("tokens", T.token_estimate(F.col("content"), tool_chars()))
    rows = _newest(rows, "tokens")
    session = Window.partitionBy("session_id")
    spent = F.coalesce(F.sum(F.when(F.col("keep_always"), F.col("tokens"))).over(session), F.lit(0))
    newest = F.coalesce(F.max(F.when(~F.col("keep_always") & (F.col("unit") == F.col("newest_unit")), F.col("running"))).over(session), F.lit(0))
    rows = rows.withColumn("spent", spent).withColumn("newest", newest)
    status = F.when(F.col("spent") > max_tokens, "preserved_over_budget").when(F.col("spent") + F.col("newest") > max_tokens, "newest_over_budget").otherwise("ok")
    rows = rows.withColumn("status", status)
    keep = F.col("keep_always") | ((F.col("status") == "ok") & (F.col("spent") + F.col("running") <= max_tokens))
    return rows.where(keep).drop("running", "newest_unit", "spent", "newest")


def _shortened(messages: DataFrame, most: int | None) -> DataFrame:
    return messages if most is None else messages.withColumn("content", T.truncated_result(F.col("content"), F.col("role"), most))


def reduced(limit: int) -> int:
    """The limit after an overflow."""
    return max(1, limit // 2)


def budget(window: int | None, ratio: float) -> int | None:
    return None if window is None else int(window * ratio)


def rollup(messages: DataFrame) -> DataFrame:
    """Messages, tokens, tool calls and reported usage of each session: combined map-side."""
    usage = lambda name: F.coalesce(F.sum(F.try_element_at("metadata", F.lit(name)).try_cast("bigint")), F.lit(0))
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(T.token_estimate(F.col("content"), tool_chars())).cast("bigint").alias("tokens"),
        F.sum(F.coalesce(F.size("tool_calls"), F.lit(0))).cast("bigint").alias("tool_calls"),
        usage("input_tokens").alias("input_tokens"),
        usage("output_tokens").alias("output_tokens"),
    )


def summary_plan(messages: DataFrame, keep: int, trigger_messages: int | None = None, trigger_tokens: int | None = None, window: int | None = None, ratio: float | None = None) -> DataFrame:
    """For each session whether a summary is due and which rows it covers: ``session_id, reason, covered``.

    Tried in order: tokens over the ratio of the model's window (if known), tokens over a count, messages at least a
    count. The last ``keep`` rows, pinned and system rows are not covered; an earlier summary is (it is merged)."""
    size = Window.partitionBy("session_id")
    rows = messages.withColumn("tokens", T.token_estimate(F.col("content"), tool_chars()))
    rows = rows.withColumn("all_tokens", F.sum("tokens").over(size)).withColumn("all_rows", F.count(F.lit(1)).over(size))
    rows = rows.withColumn("from_end", F.row_number().over(size.orderBy(F.col("pos").desc())))
    most = budget(window, ratio) if ratio is not None else None
    reason = F.lit(None).cast("string")
    if trigger_messages is not None:
        reason = F.when(F.col("all_rows") >= trigger_messages, "messages").otherwise(reason)
    if trigger_tokens is not None:
        reason = F.when(F.col("all_tokens") > trigger_tokens, "tokens").otherwise(reason)
    if most is not None:
        reason = F.when(F.col("all_tokens") > most, "ratio").otherwise(reason)
    covered = (F.col("from_end") > keep) & ~(preserved() & ~F.coalesce(F.col("kind") == "conversation_summary", F.lit(False)))
    rows = rows.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return rows.groupBy("session_id", "reason").agg(F.sum(covered.cast("int")).cast("bigint").alias("covered"), F.max("all_rows").alias("rows"), F.max("all_tokens").cast("bigint").alias("tokens"))


def healed(messages: DataFrame) -> DataFrame:
    """Missing ids from session and position: the same on every run."""
    return messages.withColumn("id", F.coalesce("id", F.concat(F.lit("m-"), F.sha2(F.concat_ws(":", "session_id", F.col("pos").cast("string")), 256).substr(1, 32))))
