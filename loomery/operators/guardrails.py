"""Guardrails over text and tool calls: ordered decisions as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the pattern guardrails look for, by label.
CREDIT_CARD = r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"
US_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PATTERNS = {"credit_card": CREDIT_CARD, "ssn": US_SSN, "email": EMAIL}
REDACTED = "[redacted]"


def _unicode(pattern: str) -> str:
    return f"(?U){pattern}"


def labels(value: Column, patterns: dict[str, str]) -> Column:
    """The labels of the patterns found, in order."""
    return F.filter(F.array(*[F.when(value.rlike(_unicode(p)), F.lit(name)) for name, p in patterns.items()]), lambda x: x.isNotNull())


def redacted(value: Column, patterns: dict[str, str], by: str = REDACTED) -> Column:
    for p in patterns.values():
        value = F.regexp_replace(value, _unicode(p), by.replace("\\", "\\\\").replace("$", "\\$"))
    return value


@dataclass
class Guard:
    """One step of a chain: the condition under which it acts, and what it does to the value.

    ``action`` is block, confirm or transform; ``condition`` and ``transform`` take the value column, ``reason`` gives the
    text of a decision.
    """

    name: str
    action: str
    condition: object
    reason: object
    transform: object = None


def pattern_guard(name: str, action: str, patterns: dict[str, str], boundary: str) -> Guard:
    verb = "matched" if action == "block" else "redacted"
    return Guard(
        name,
        action,
        lambda v: F.size(labels(v, patterns)) > 0,
        lambda v: F.concat(F.lit(f"{verb} "), F.array_join(labels(v, patterns), ", "), F.lit(f" at {boundary}")),
        lambda v: redacted(v, patterns),
    )


def chain(df: DataFrame, value: str, guards: list[Guard], shadow: bool = False) -> DataFrame:
    """Add ``action`` (allow, block, confirm, transform), ``reason``, ``result`` and ``decisions`` (of all guards that acted).

    In order, each guard sees the value as those before it left it; the first block or confirm ends the chain. In shadow
    mode every guard sees the original, all is recorded and nothing changed."""
    out = df.withColumn("__v", F.col(value)).withColumn("__stop", F.lit(None).cast("string")).withColumn("__why", F.lit(None).cast("string"))
    records = []
    for i, g in enumerate(guards):
        acts, why = f"__a{i}", f"__r{i}"
        out = out.withColumn(acts, F.coalesce(g.condition(F.col("__v")), F.lit(False)) & F.col("__stop").isNull()).withColumn(why, F.when(F.col(acts), g.reason(F.col("__v"))))
        records.append(F.when(F.col(acts), F.concat_ws(":", F.lit(g.name), F.lit(g.action))))
        if shadow:
            continue
        if g.action == "transform":
            out = out.withColumn("__v", F.when(F.col(acts), g.transform(F.col("__v"))).otherwise(F.col("__v")))
        else:
            out = out.withColumn("__why", F.when(F.col(acts), F.col(why)).otherwise(F.col("__why"))).withColumn("__stop", F.when(F.col(acts), F.lit(g.action)).otherwise(F.col("__stop")))
    reasons = F.filter(F.array(*[F.col(f"__r{i}") for i in range(len(guards))]), lambda x: x.isNotNull())
    changed = ~F.col("__v").eqNullSafe(F.col(value)) if not shadow else F.lit(False)
    out = out.withColumn("decisions", F.filter(F.array(*records), lambda x: x.isNotNull()))
    out = out.withColumn("action", F.coalesce("__stop", F.when(changed, "transform"), F.lit("allow")))
    out = out.withColumn("reason", F.when(F.col("__stop").isNotNull(), F.col("__why")).when(changed, F.array_join(reasons, "; ")))
    out = out.withColumn("result", F.when(F.col("__stop").isNull(), F.col("__v")))
    return out.drop("__v", "__stop", "__why", *[f"__a{i}" for i in range(len(guards))], *[f"__r{i}" for i in range(len(guards))])


def tool_permission(tool: Column, allow: list[str] | None = None, deny: list[str] | None = None, rules: dict[str, tuple[Column, str]] | None = None) -> Column:
    """A struct (action, reason): deny before allow list before the rule of the tool (a condition that blocks, a reason)."""
    block = lambda why: F.struct(F.lit("block").alias("action"), why.alias("reason"))
    out = F.when(tool.isin(deny or []), block(F.concat(tool, F.lit(" is denied"))))
    if allow is not None:
        out = out.when(~F.coalesce(tool.isin(allow), F.lit(False)), block(F.concat(F.coalesce(tool, F.lit("null")), F.lit(" is not allowed"))))
    for name, (condition, why) in (rules or {}).items():
        out = out.when((tool == name) & condition, block(F.lit(why)))
    return out.otherwise(F.struct(F.lit("allow").alias("action"), F.lit(None).cast("string").alias("reason")))


def approval(tool: Column, rules: dict[str, tuple[Column, str]]) -> Column:
    """confirm with a reason where the rule of the tool holds, else allow."""
    out = None
    for name, (condition, why) in rules.items():
        value = F.struct(F.lit("confirm").alias("action"), F.lit(why).alias("reason"))
        out = F.when((tool == name) & condition, value) if out is None else out.when((tool == name) & condition, value)
    allow = F.struct(F.lit("allow").alias("action"), F.lit(None).cast("string").alias("reason"))
    return allow if out is None else out.otherwise(allow)


def approved(requests: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Requests to confirm with the decision of an approver; without one they stay pending."""
    out = requests.join(decisions.select(*keys, F.col("approved").alias("__ok")), keys, "left")
    return out.withColumn("outcome", F.when(F.col("action") != "confirm", F.col("action")).when(F.col("__ok").isNull(), "pending").otherwise(F.when(F.col("__ok"), "allow").otherwise("block"))).drop("__ok")
