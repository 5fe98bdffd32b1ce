"""Evaluation of traces: trajectories, tool parameters, judges and rollups of scores."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.errors import JudgeError
from loomery.functions import text as T


def exact(expected: Column, actual: Column) -> Column:
    return expected == actual


def in_order(expected: Column, actual: Column) -> Column:
    """Whether ``expected`` is a subsequence of ``actual``."""
    return F.aggregate(actual, F.lit(0), lambda i, x: F.when((i < F.size(expected)) & (F.get(expected, i) == x), i + 1).otherwise(i)) == F.size(expected)


def overlap(expected: Column, actual: Column) -> Column:
    """Size of the intersection as multisets."""
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.aggregate(F.array_distinct(expected), F.lit(0), lambda n, x: n + F.least(times(expected, x), times(actual, x)))


def any_order(expected: Column, actual: Column) -> Column:
    return overlap(expected, actual) == F.size(expected)


def coverage(expected: Column, actual: Column) -> Column:
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(overlap(expected, actual) / F.size(expected))


def surplus(a: Column, b: Column) -> Column:
    """Sorted names that ``a`` has more often than ``b``, as often as it has them more."""
    times = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    more = F.transform(F.array_sort(F.array_distinct(a)), lambda x: F.array_repeat(x, F.greatest(F.lit(0), times(a, x) - times(b, x))))
    return F.flatten(more)


def trajectory(df: DataFrame, expected: str, actual: str, mode: str) -> DataFrame:
    """Add ``passed, score, coverage, missing, extra``. Without ground truth (null) all are null: the trial is skipped."""
    e, a = F.col(expected), F.coalesce(F.col(actual), F.array().cast("array<string>"))
    passed = {"exact": exact, "in-order": in_order, "any-order": any_order}[mode](e, a)
    out = df.withColumn("passed", passed).withColumn("coverage", F.when(e.isNotNull(), coverage(e, a)))
    out = out.withColumn("score", F.when(F.col("passed"), 1.0).otherwise(F.col("coverage")))
    return out.withColumn("missing", F.when(e.isNotNull(), surplus(e, a))).withColumn("extra", F.when(e.isNotNull(), surplus(a, e)))


def tool_parameters(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, total, matched, missing_calls, mismatched_fields, passed, score``.

    ``expected`` and ``actual`` have ``keys, pos, name, args MAP``. The n-th expected call of a name claims the n-th actual
    one; every expected field must be there and equal, others are ignored."""
    nth = Window.partitionBy(*keys, "name").orderBy("pos")
    e = expected.withColumn("nth", F.row_number().over(nth)).withColumnRenamed("args", "wanted").drop("pos")
    a = actual.withColumn("nth", F.row_number().over(nth)).withColumnRenamed("args", "got").drop("pos")
    both = e.join(a, [*keys, "name", "nth"], "left")
    fields = F.coalesce(F.map_entries("wanted"), F.array().cast("array<struct<key:string,value:string>>"))
    wrong = F.size(F.filter(fields, lambda f: ~F.coalesce(F.try_element_at(F.col("got"), f["key"]).eqNullSafe(f["value"]) & F.map_contains_key(F.col("got"), f["key"]), F.lit(False))))
    both = both.withColumn("absent", F.col("got").isNull()).withColumn("wrong", F.when(F.col("got").isNull(), 0).otherwise(wrong))
    out = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((~F.col("absent") & (F.col("wrong") == 0)).cast("bigint")).alias("matched"),
        F.sum(F.col("absent").cast("bigint")).alias("missing_calls"),
        F.sum(F.col("wrong").cast("bigint")).alias("mismatched_fields"),
    )
    return out.withColumn("passed", (F.col("missing_calls") == 0) & (F.col("mismatched_fields") == 0)).withColumn("score", F.col("matched") / F.col("total"))


def trials(scores: DataFrame, planned: DataFrame) -> DataFrame:
    """``case_id, trial, passed``: a trial passes when it has scores and all pass; ``planned`` names all trials."""
    judged = scores.where("passed IS NOT NULL").groupBy("case_id", "trial").agg(F.bool_and("passed").alias("p"))
    return planned.select("case_id", "trial").distinct().join(judged, ["case_id", "trial"], "left").select("case_id", "trial", F.coalesce("p", F.lit(False)).alias("passed"))


def cases(trial_rows: DataFrame) -> DataFrame:
    return trial_rows.groupBy("case_id").agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("trials"))


def rates(trial_rows: DataFrame) -> DataFrame:
    """One row: ``pass_rate`` over trials and ``pass_hat_k`` over cases of which all trials pass."""
    by_case = trial_rows.groupBy("case_id").agg(F.sum(F.col("passed").cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n"))
    return by_case.agg(F.coalesce(F.sum("p") / F.sum("n"), F.lit(0.0)).alias("pass_rate"), F.coalesce(F.avg((F.col("p") == F.col("n")).cast("int")), F.lit(0.0)).alias("pass_hat_k"))


def dimensions(scores: DataFrame) -> DataFrame:
    return scores.where("score IS NOT NULL").groupBy("dimension").agg(F.avg("score").alias("average"), F.count(F.lit(1)).alias("scores"))


def failures(scores: DataFrame) -> DataFrame:
    return scores.where("NOT passed")


def verdict(reply: str | None) -> tuple[bool, float, str] | None:
    """(passed, score, reason) of a judge's reply; None when it is no JSON object, when ``passed`` is not true or false, or
    when ``score`` is no number. An absent score is 0; scores are brought into [0, 1]."""
    try:
        found = json.loads(re.sub(r"^\s*`+(?:json)?|`+\s*$", "", reply or ""))
        if isinstance(found, dict) and isinstance(found.get("passed"), bool):
            return found["passed"], min(1.0, max(0.0, float(found.get("score", 0.0)))), str(found.get("reason", "")).strip()
    except (ValueError, TypeError):
        pass
    return None


def answered(df: DataFrame, prompt: str, model: Callable[[str], str], name: str) -> DataFrame:
    """Add the model's answer to each prompt as column ``name``; null for a null prompt."""
    df = df.select(*[c for c in df.columns if c != name])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: [model(t) if isinstance(t, str) else None for t in pdf[prompt]]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{name}` string")


def judged(df: DataFrame, prompt: str, judge: Callable[[str], str], tries: int = 2) -> DataFrame:
    """Add ``passed, score, reason`` from the JSON verdict of a judge model, asked again when it gives none; after
    ``tries`` failures passed and score are null and the reason is the code of a judge error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [next((v for _ in range(tries) if (v := verdict(judge(t or "")))), (None, None, JudgeError.code)) for t in pdf[prompt]]
            yield pdf.assign(passed=pd.array([r[0] for r in rows], dtype="boolean"), score=[r[1] for r in rows], reason=[r[2] for r in rows])

    df = df.select(*[c for c in df.columns if c not in ("passed", "score", "reason")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, passed boolean, score double, reason string")


def faithfulness(claims: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, score, passed`` from claims with ``supported``; a null claim stands for an answer without claims."""
    supported = F.sum(F.when(F.col("claim").isNotNull(), F.coalesce(F.col("supported"), F.lit(False)).cast("int")))
    count = F.count("claim")
    out = claims.groupBy(*keys).agg(F.when(count == 0, 1.0).otherwise(supported / count).alias("score"))
    return out.withColumn("passed", F.col("score") == 1.0)


def report(name: str, rate_row, averages: list, failing: list) -> str:
    """A text report of one run; the arguments are rows of ``rates``, ``dimensions`` and ``failures``."""
    lines = [f"run: {name}", f"pass rate: {rate_row['pass_rate']:.1%}", f"pass^k: {rate_row['pass_hat_k']:.1%}"]
    lines += [f"  {r['dimension']}: {r['average']:.3f}" for r in sorted(averages, key=lambda r: r["dimension"])]
    lines += [f"failed {r['case_id']}/{r['trial']} {r['dimension']}" for r in failing]
    return "\n".join(lines)


def word_support(answer: Column, context: Column) -> Column:
    """A deterministic stand-in for a judge: the share of the answer's words that the context has."""
    return T.overlap(answer, context)
