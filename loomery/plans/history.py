"""p3: versions of the attributes of memory entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators.history import history, hot_keys, merge_updates, with_state
from loomery.plans.tables import table

#: Between the first load and the batch of ``p3_merged``.
CUT = "2025-06-01 00:00:00"
KEYS = ["namespace", "key"]


def _log(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memory_entries").where("namespace IS NOT NULL AND key IS NOT NULL AND created_at IS NOT NULL")
    return with_state(rows.select(*KEYS, "created_at", "ord", "invalidated_at", "data"), "data")


def _closed(versions: DataFrame) -> DataFrame:
    return versions.withColumn("valid_to_us", F.coalesce("valid_to_us", F.lit(-1).cast("bigint")))


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    hot = hot_keys(table(spark, folder, "memory_entries").select(*KEYS).where("key IS NOT NULL"), KEYS)
    return history(_log(spark, folder), KEYS, "created_at", ["ord"], "state", "invalidated_at", hot=hot)


def p3_versions(spark: SparkSession, folder: str) -> DataFrame:
    return _closed(_versions(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Versions are one for each key and start, so no rows repeat."""
    return _closed(_versions(spark, folder)).select("namespace", "key", "valid_from_us", "valid_to_us")


def p3_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The versions of the log up to ``CUT`` with the rest of it merged into them."""
    log = _log(spark, folder)
    loaded = history(log.where(F.col("created_at") < F.lit(CUT).cast("timestamp")), KEYS, "created_at", ["ord"], "state", "invalidated_at")
    return _closed(merge_updates(loaded, log.where(F.col("created_at") >= F.lit(CUT).cast("timestamp")), KEYS, "created_at", ["ord"], "state", "invalidated_at"))


QUERIES = {"p3_found": p3_found, "p3_versions": p3_versions, "p3_merged": p3_merged}

_VERSIONS = """
WITH parsed AS (
  SELECT DISTINCT namespace, key, epoch_us(created_at) AS s, ord, epoch_us(invalidated_at) AS inv,
         CAST(TRY_CAST(data AS JSON) AS JSON) AS j
  FROM memory_entries WHERE key IS NOT NULL AND namespace IS NOT NULL AND created_at IS NOT NULL AND json_valid(data)
), attrs AS (
  SELECT namespace, key, s, ord, inv, json_extract(j, '$.metadata.attributes') AS a FROM parsed WHERE json_type(j) = 'OBJECT'
), states AS (
  SELECT namespace, key, s, ord, inv,
    coalesce((SELECT '[' || string_agg('{"k":"' || k || '","v":' || to_json(v) || '}', ',' ORDER BY k) || ']'
      FROM (SELECT unnest(json_keys(a)) AS k) t, LATERAL (SELECT regexp_replace(CAST(json_extract(a, '$."' || k || '"') AS VARCHAR), '^(-?[0-9]+)[.]0+$', '\\1') AS v)
      WHERE v IS NOT NULL AND v <> 'null'), '[]') AS state
  FROM attrs
), periods AS (
  SELECT *, least(coalesce(lead(s) OVER w, inv), coalesce(inv, lead(s) OVER w)) AS e FROM states WINDOW w AS (PARTITION BY namespace, key ORDER BY s, ord)
), held AS (SELECT * FROM periods WHERE e IS NULL OR e > s),
flagged AS (
  SELECT *, CASE WHEN lag(e) OVER w = s AND lag(state) OVER w = state THEN 0 ELSE 1 END AS fresh FROM held WINDOW w AS (PARTITION BY namespace, key ORDER BY s)
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY namespace, key ORDER BY s) AS version FROM flagged)
SELECT namespace, key, min(s) AS valid_from_us, CASE WHEN bool_or(e IS NULL) THEN -1 ELSE max(e) END AS valid_to_us, any_value(state) AS state
FROM numbered GROUP BY namespace, key, version
"""

ORACLE = {
    "p3_found": f"SELECT DISTINCT namespace, key, valid_from_us, valid_to_us FROM ({_VERSIONS})",
    "p3_versions": _VERSIONS,
    "p3_merged": _VERSIONS,
}
