"""Filling containers of fixed capacity: bounded-space best fit in every partition, then a tree of merges."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.session import checkpoint

WINDOWS = 256
FAN_IN = 64


class Packer:
    """At most ``windows`` open containers. An item goes into the one it leaves least room in; when it fits in none and
    all are open, the fullest is emitted. An item of full size has a container of its own."""

    def __init__(self, capacity: int, windows: int) -> None:
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, int]] = []  # (room, number), by room
        self.next = 0

    def place(self, size: int) -> int:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            room, number = self.capacity, self.next
            self.next += 1
            if size < self.capacity and len(self.open) >= self.windows:
                self.open.pop(0)  # the fullest
        if room > size:
            insort(self.open, (room - size, number))
        return number


def _placed(capacity: int, windows: int, level: int):
    """Items with their ``box``; then, for each container still open at the end of the partition, a row with its ``size``
    and ``left`` true."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, base, columns = Packer(capacity, windows), None, None
        for pdf in batches:
            if base is None and len(pdf):
                base, columns = (level << 58) | (int(pdf["part"].iloc[0]) << 33), [c for c in pdf.columns if c != "part"]
            numbers = [packer.place(int(n)) for n in pdf["size"]]
            yield pdf.drop(columns="part").assign(box=[base | n for n in numbers], left=False)
        if packer.open:
            rest = pd.DataFrame({"size": [capacity - room for room, _ in packer.open], "box": [base | n for _, n in packer.open]})
            yield rest.assign(left=True).reindex(columns=[*columns, "box", "left"])

    return run


def _packed(items: DataFrame, fields: str, capacity: int, windows: int, parts: int, level: int) -> DataFrame:
    """The order within a partition is that of a hash, so a repeated task places alike."""
    names = [f.split()[0] for f in fields.split(", ")]
    spread = items.select(names).repartition(parts, "item").withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.xxhash64("item"), *names)
    return checkpoint(spread.mapInPandas(_placed(capacity, windows, level), f"{fields}, box bigint, left boolean"))


def pack(items: DataFrame, key: str, size: str, capacity: int, windows: int = WINDOWS, parts: int | None = None) -> DataFrame:
    """``key, piece_no, start, size, container``: every row of ``items`` in a container of at most ``capacity``.

    An item within the capacity is never split; a larger one is cut into full pieces and a rest. In each partition a
    fixed number of containers is open; only those still open at its end, at most ``windows``, go up as the items of the
    next level, which has a ``FAN_IN``-th of the partitions, until one partition is left. So whatever the sizes, no task
    above the first level sees more than ``FAN_IN * windows`` items. Rows with a null key or size, or a size under 1, have
    no place; a repeated key is an item for each row. ``key`` must be a bigint.
    """
    if capacity < 1 or windows < 1:
        raise ValueError("capacity and windows must be positive")
    parts = parts or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = items.where(f"`{key}` IS NOT NULL AND `{size}` >= 1").select(F.col(key).alias("key"), F.col(size).cast("int").alias("whole"))
    last = F.expr(f"int((whole - 1) div {capacity})")
    cut = rows.select("key", "whole", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    cut = cut.select("key", "piece_no", (F.col("piece_no") * capacity).alias("start"), F.least(F.lit(capacity), F.col("whole") - F.col("piece_no") * capacity).alias("size"))
    placed = _packed(cut.withColumn("item", F.xxhash64("key", "piece_no")), "item bigint, key bigint, piece_no int, start int, size int", capacity, windows, parts, 1)
    out = placed.where("NOT left")
    boxes = placed.where("left").select(F.col("box").alias("item"), "size")
    moved, level = None, 2
    while parts > 1:
        parts, level = max(1, parts // FAN_IN), level + 1
        step = _packed(boxes, "item bigint, size int", capacity, windows, parts, level)
        now = step.where("NOT left").select(F.col("item").alias("old"), F.col("box").alias("new"))
        boxes = step.where("left").select(F.col("box").alias("item"), "size")
        if moved is None:
            moved = now
        else:  # what is closed on a level keeps its container
            moved = checkpoint(moved.join(now.select(F.col("old").alias("new"), F.col("new").alias("newer")), "new", "left").select("old", F.coalesce("newer", "new").alias("new")))
    if moved is not None:
        out = out.join(moved, out["box"] == moved["old"], "left").withColumn("box", F.coalesce("new", "box"))
    return out.select(F.col("key").alias(key), "piece_no", "start", "size", F.col("box").alias("container"))
