"""Stateful triggers on streams: every n-th message, and reflection thresholds.

State is a count and a sum for each key. The order of a key's rows within a micro-batch is that of ``ts`` and ``ord``; late
rows count when they arrive. The state of a key is kept: with a timeout by processing time a run over what is there would
never end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

POINTS = "key string, ord bigint, observed bigint, total double"


def threshold_points(stream: DataFrame, key: str, ts: str, ord: str, weight: str, most_count: int, most_total: float | None = None) -> DataFrame:
    """``key, ord, observed, total`` for each row at which the count or the sum of weights since the last such row reaches
    its limit; then both start anew. With ``most_total`` None it is an interval trigger."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, total = state.get if state.exists else (0, 0.0)
        frames = [pdf for pdf in batches if len(pdf)]
        out = []
        if frames:
            for o, w in pd.concat(frames).sort_values(["ts", "ord"])[["ord", "weight"]].itertuples(index=False):
                count, total = count + 1, total + (0.0 if pd.isna(w) else float(w))
                if count >= most_count or (most_total is not None and total >= most_total):
                    out.append((group[0], int(o), count, total))
                    count, total = 0, 0.0
        state.update((count, total))
        yield pd.DataFrame(out, columns=["key", "ord", "observed", "total"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(ord).cast("bigint").alias("ord"), F.col(weight).cast("double").alias("weight"))
    return rows.where("key IS NOT NULL").groupBy("key").applyInPandasWithState(run, POINTS, "count bigint, total double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows for each key in each tumbling window, with a watermark. In append mode a window is written once the watermark
    has passed it, which the last ones of a bounded run never see; ``run_once`` in mode complete writes all."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("start"), key, "rows")


def run_once(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into parquet files, and read them. In mode complete each batch replaces the
    files by the whole result."""
    if mode == "complete":
        stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(out)  # of a stream without rows
        query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(out)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
