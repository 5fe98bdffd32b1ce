"""Mixing sources to target weights under limits of repetition."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.session import checkpoint

BLOCK_ROWS = 1000
GROUPS = 1024
MOST_TARGETS = 10_000


def source_name(source: Column) -> Column:
    """A source in one spelling: lower case, without outer blanks, separators as underscores."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s\-_/.]+", "_"), F.lit(""))


def bisect(good, low: float, high: float, rounds: int = 60) -> float:
    """The largest value in [low, high] that is ``good``, for a condition that holds up to some value; ``low`` is taken
    as good."""
    if good(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total else weights


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def temperature_weights(sizes: dict[str, float], target_entropy: float | None = None, total: float | None = None, repeats: dict[str, int] | None = None) -> dict[str, float]:
    """Shares to a power: w ~ share ** x. x falls from 1 (the natural shares) towards 0 (equal ones) until the entropy
    reaches ``target_entropy``, or as far as a mix of ``total`` repeats no source more often than it may."""
    usable = {k: v for k, v in sizes.items() if v > 0 and (repeats is None or repeats.get(k, 0) > 0)}
    shares = normalised(usable)

    def at(flat: float) -> dict[str, float]:
        return normalised({k: v ** (1 - flat) for k, v in shares.items()})

    def good(flat: float) -> bool:
        w = at(flat)
        within = total is None or repeats is None or all(total * w[k] <= sizes[k] * repeats[k] * (1 + 1e-12) for k in w)
        return within and (target_entropy is None or entropy(w) <= target_entropy)

    return at(bisect(good, 0.0, 1.0)) if shares else {}


def target_weights(sizes: dict[str, float], targets: dict[str, float], repeats: dict[str, int], total: float) -> tuple[dict[str, float], float, float]:
    """(shares, total, exponent): w ~ share * (target / share) ** x, the natural shares to the power 1 - x and the targets
    to the power x.

    x is bisected: the largest at which a mix of ``total`` repeats no source more often than it may, so 1, the targets
    themselves, where the limits allow it. What even x = 0 can't give is filled from the sources that have some left.
    Sources of size, target or limit 0 have no share, and the others' are normalised without them.
    """
    shares = normalised({k: sizes[k] for k in targets if sizes.get(k, 0) > 0 and targets[k] > 0 and repeats.get(k, 0) > 0})
    if not shares or total <= 0:
        return {}, 0.0, 1.0
    wanted = normalised({k: targets[k] for k in shares})
    caps = {k: sizes[k] * repeats[k] for k in shares}

    def at(x: float) -> dict[str, float]:
        return normalised({k: shares[k] ** (1 - x) * wanted[k] ** x for k in shares})

    x = bisect(lambda x: all(total * w <= caps[k] * (1 + 1e-12) for k, w in at(x).items()), 0.0, 1.0)
    budget = {k: min(caps[k], total * w) for k, w in at(x).items()}
    room = {k: caps[k] - b for k, b in budget.items()}
    lacking = min(total - sum(budget.values()), sum(room.values()))
    if lacking > 0 and sum(room.values()) > 0:
        budget = {k: b + lacking * room[k] / sum(room.values()) for k, b in budget.items()}
    return normalised(budget), sum(budget.values()), x


def once_each(items: DataFrame, sources: list[str]) -> DataFrame:
    """``text_key, source, size, order``, written: of copies of a text the one with the least doc_id in one of the sources."""
    known = items.withColumn("source", source_name(F.col("source"))).where(F.col("source").isin(sources) & (F.col("size") > 0) & F.col("text_key").isNotNull())
    least = known.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "size")).alias("m")).select("text_key", "m.source", "m.size")
    return checkpoint(least.withColumn("order", F.xxhash64(F.lit("mix"), "text_key")))


def read_targets(targets: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    """(share, repetitions) of each source. More than ``MOST_TARGETS`` rows are an error: none is left out."""
    rows = targets.where("source IS NOT NULL").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").take(MOST_TARGETS + 1)
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return {r["source"]: float(r["target_share"] or 0) for r in rows}, {r["source"]: max(0, int(r["max_repeats"] or 0)) for r in rows}


def realised(once: DataFrame, sums: dict[str, tuple[int, int]], weights: dict[str, float], total: float, repeats: dict[str, int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``text_key, source, size, uses`` for the weights: each source is gone through as a whole as often as its budget
    allows; the rest comes from whole blocks in the order of a hash and from the shortest items of one more block, so it is
    right to half an item. Running sums go over at most ``GROUPS`` groups of blocks a source, then inside a group,
    then inside the one block that is cut, so no source is summed up in one task."""
    plan = []
    for k, w in weights.items():
        count, size = sums[k]
        budget = min(w * total, float(size) * repeats[k])
        full = min(int(budget // size), repeats[k])
        plan.append((k, full, float(budget - full * size), max(1, -(-count // block_rows))))
    plans = F.broadcast(once.sparkSession.createDataFrame(plan, "source string, full int, rest double, blocks long"))  # a row for each target
    placed = once.join(plans, "source").withColumn("block", F.pmod(F.col("order"), F.col("blocks"))).withColumn("turn", F.xxhash64("block"))
    blocks = placed.groupBy("source", F.pmod("turn", F.lit(GROUPS)).alias("group"), "turn", "block").agg(F.sum("size").alias("held"))
    before = lambda *by: Window.partitionBy(*by)
    groups = blocks.groupBy("source", "group").agg(F.sum("held").alias("all"))
    groups = groups.withColumn("from", F.sum("all").over(before("source").orderBy("group")) - F.col("all")).drop("all")
    blocks = blocks.join(groups, ["source", "group"]).withColumn("through", F.col("from") + F.sum("held").over(before("source", "group").orderBy("turn", "block")))
    blocks = blocks.select("source", "block", "through", (F.col("through") - F.col("held")).alias("start"))
    placed = placed.join(blocks, ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy("size", "order", "text_key")
    cut = placed.where((F.col("start") < F.col("rest")) & (F.col("through") > F.col("rest"))).withColumn("run", F.col("start") + F.sum("size").over(inside))
    extra = placed.where(F.col("through") <= F.col("rest")).select("text_key", F.lit(1).alias("more"))
    extra = extra.unionByName(cut.where(F.col("run") <= F.col("rest") + F.col("size") / 2).select("text_key", F.lit(1).alias("more")))
    out = placed.select("text_key", "source", "size", "full").join(extra, "text_key", "left")
    return out.select("text_key", "source", "size", (F.col("full") + F.coalesce("more", F.lit(0))).alias("uses")).where("uses > 0")


@dataclass
class Mix:
    items: DataFrame  # text_key, source, size, uses
    weights: dict[str, float]
    total: float
    exponent: float


def _sums(once: DataFrame) -> dict[str, tuple[int, int]]:
    """Number and size of the items of each source that has a target."""
    return {r["source"]: (r["n"], r["s"]) for r in once.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).collect()}


def mix(items: DataFrame, targets: DataFrame, total: float | None = None, block_rows: int = BLOCK_ROWS) -> Mix:
    """A mix with the shares of ``targets`` (source, target_share, max_repeats), as near to them as the repetition limits
    let a mix of ``total`` be; without ``total`` it has the size of all different items with a source that has a target.

    ``items`` has text_key (equal texts have equal keys), doc_id, source and size. Of copies of a text one stands for all,
    so no text is used more than max_repeats times. Items without a source, with one that has no target, or of size 0 are
    in no mix.
    """
    wanted, repeats = read_targets(targets)
    once = once_each(items, list(wanted))
    sums = _sums(once)
    sizes = {k: float(s) for k, (_, s) in sums.items()}
    weights, whole, x = target_weights(sizes, wanted, repeats, sum(sizes.values()) if total is None else total)
    return Mix(realised(once, sums, weights, whole, repeats, block_rows), weights, whole, x)


def temperature_mix(items: DataFrame, targets: DataFrame, total: float | None = None, block_rows: int = BLOCK_ROWS) -> Mix:
    """A mix whose weights are the natural token shares to one power, bisected until their entropy is that of the target
    shares or a source would be repeated too often. Of ``targets`` only the entropy and the limits count."""
    wanted, repeats = read_targets(targets)
    once = once_each(items, list(wanted))
    sums = _sums(once)
    sizes = {k: float(s) for k, (_, s) in sums.items()}
    total = sum(sizes.values()) if total is None else total
    weights = temperature_weights(sizes, entropy(normalised(wanted)), total, repeats)
    caps = sum(sizes[k] * repeats[k] for k in weights)
    return Mix(realised(once, sums, weights, min(total, caps), repeats, block_rows), weights, min(total, caps), exponent_of(sizes, weights))


def exponent_of(sizes: dict[str, float], weights: dict[str, float]) -> float:
    """x of w ~ size ** x; 1 when all sizes are equal."""
    ranked = sorted((k for k in weights if weights[k] > 0), key=lambda k: sizes[k])
    if len(ranked) < 2 or sizes[ranked[0]] == sizes[ranked[-1]]:
        return 1.0
    return math.log(weights[ranked[-1]] / weights[ranked[0]]) / math.log(sizes[ranked[-1]] / sizes[ranked[0]])


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, used, texts, most_uses`` for every source of ``targets``, also absent ones."""
    used = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("used"), F.count(F.lit(1)).alias("texts"), F.max("uses").alias("most_uses"))
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share")
    all_ = Window.partitionBy()  # one row for each target
    joined = wanted.join(used, "source", "left").fillna(0, ["used", "texts", "most_uses"])
    total = F.sum("used").over(all_)
    return joined.select("source", "target_share", F.when(total > 0, F.col("used") / total).otherwise(0.0).alias("actual_share"), "used", "texts", "most_uses")
