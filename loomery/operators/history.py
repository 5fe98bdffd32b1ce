"""Type-two history: from a log of full states to versions with their periods of validity.

Every step is a window over ``(keys, slice)`` in the order of time, so one shuffle and one sort serve them all. A slice is
0, but for keys with very many rows it is a span of time, and a second window over the ends of the slices joins them: a
key that holds a third of the log is sorted in many tasks, and the results are those of one window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.session import checkpoint

#: Keys of more rows are cut into slices; results are the same for any value.
HOT_ROWS = 200_000
SLICE_DAYS = 7
#: So many hot keys are broadcast at most; more are joined by sorting.
BROADCAST_KEYS = 100_000


def hot_keys(log: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """(keys of more than ``hot_rows`` rows, their number): at most one in ``hot_rows`` rows. Reads the keys only."""
    hot = checkpoint(log.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(*[F.col(k).alias(f"__{k}") for k in keys]))
    return hot, hot.count()


def sliced(df: DataFrame, keys: list[str], micros: str, hot: DataFrame, count: int, slice_days: int = SLICE_DAYS) -> DataFrame:
    """Add column ``slice``: 0, or for a hot key the number of the span of time, which is never 0."""
    if not count:
        return df.withColumn("slice", F.lit(0).cast("bigint"))
    hot = F.broadcast(hot) if count <= BROADCAST_KEYS else hot
    joined = df.join(hot, [df[k] == hot[f"__{k}"] for k in keys], "left")
    span = F.floor(F.col(micros) / F.lit(slice_days * 86_400_000_000)).cast("bigint") * 2 + 1
    return joined.withColumn("slice", F.when(F.col(f"__{keys[0]}").isNotNull(), span).otherwise(0)).drop(*[f"__{k}" for k in keys])


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: Column, across: bool, after: str | None = None, before: str | None = None) -> DataFrame:
    """Add ``value`` of the next row of the same keys as column ``after`` and that of the previous row as ``before``, each
    as a struct with the field ``v``, null where there is no such row.

    ``df`` has the column of ``sliced``; the keys must not be null. ``order`` must be total: on rows equal in all of it
    the result is one of the valid orders. With ``across`` the slices are joined through their first and last rows.
    """
    inner = Window.partitionBy(*keys, "slice").orderBy(*order)
    df = df.withColumn("__here", F.struct(value.alias("v")))
    wanted = [(after, F.lead, 1), (before, F.lag, -1)]
    df = df.withColumns({name: step("__here").over(inner) for name, step, _ in wanted if name})
    if across:
        df = checkpoint(df)
        for name, _, way in wanted:
            if name:
                ends = F.max_by if way < 0 else F.min_by  # the row of a slice that the next or previous slice looks at
                edges = df.groupBy(*keys, "slice").agg(ends("__here", F.struct(*order)).alias("__edge"))
                beyond = Window.partitionBy(*keys).orderBy(F.col("slice").asc() if way > 0 else F.col("slice").desc())
                edges = edges.withColumn("__far", F.lead("__edge").over(beyond)).select(*[F.col(k).alias(f"__{k}") for k in [*keys, "slice"]], "__far")
                df = df.join(edges, [F.col(k) == F.col(f"__{k}") for k in [*keys, "slice"]], "left")
                df = df.withColumn(name, F.coalesce(name, "__far")).drop("__far", *[f"__{k}" for k in [*keys, "slice"]])
    return df.drop("__here")


def with_state(df: DataFrame, data: str, name: str = "state") -> DataFrame:
    """Replace ``data`` by ``attribute_state`` of it; rows whose ``data`` is not a JSON object are left out. The text is
    parsed once: what a generator gives is not computed again for a filter."""
    others = [c for c in df.columns if c != data]
    text = F.btrim(F.col(data), F.lit(" \t\r\n"))
    parsed = F.try_parse_json(F.when(text.startswith("{") & text.endswith("}"), F.col(data)))
    rows = df.select(*others, F.explode(F.array_compact(F.array(parsed))).alias("__parsed"))
    return rows.select(*others, _attributes(F.col("__parsed")).alias(name))


def attribute_state(data: Column) -> Column:
    """Canonical text of ``metadata.attributes`` in a JSON object, null when ``data`` is not a JSON object.

    Names are sorted, names with a null value are absent, numbers are compared by value (1 equals 1.0 and 1e0), and a
    number, a truth value and a string of the same spelling differ. Missing or non-object attributes are the empty state.
    """
    text = F.btrim(data, F.lit(" \t\r\n"))
    parsed = F.try_parse_json(data)
    return F.when(text.startswith("{") & text.endswith("}") & parsed.isNotNull(), _attributes(parsed))


def _attributes(parsed: Column) -> Column:
    attributes = F.try_variant_get(parsed, "$.metadata.attributes", "map<string,variant>")
    entries = F.transform(F.map_entries(attributes), lambda e: F.struct(e["key"].alias("k"), _canonical(F.to_json(e["value"])).alias("v")))
    return F.coalesce(F.to_json(F.array_sort(F.filter(entries, lambda e: e["v"] != "null"))), F.lit("[]"))


def _canonical(raw: Column) -> Column:
    """JSON text of a value; numbers without needless zeros and, where 37 digits suffice, without an exponent."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"^-?(0?)\.?$|\.$", "$1")
    plain = F.when(~raw.contains("."), raw).otherwise(bare(raw))
    tiny, great = bare(raw.try_cast("decimal(38,37)").cast("string")), raw.try_cast("decimal(38,0)").cast("string")
    exact = F.when(raw.contains("E-"), F.when(tiny != "0", tiny)).otherwise(great)
    return F.when(raw.rlike(r"^-?\d"), F.when(raw.contains("E"), F.coalesce(exact, raw)).otherwise(plain)).otherwise(raw)


def history(
    log: DataFrame,
    keys: list[str],
    valid_from: str,
    order: list[str],
    state: str,
    ends: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """Versions of ``state`` per key: ``keys, valid_from_us, valid_to_us, state`` (``valid_to_us`` null when still open).

    ``log`` has one row per observed state. Ordered by ``valid_from`` and ``order``, a row holds until the next row of
    its key or until its own ``ends``, whichever is earlier. Rows with an empty period drop out; touching periods with
    equal state hashes (128 bits) form one version: its row is inserted when the hash differs from that of the version
    open until then, which is closed at that moment.

    Rows with a null key part, ``valid_from`` or ``state`` are left out. Exact repeats change nothing, an empty log
    gives no rows, columns beyond those named are ignored, whatever their names. ``hot`` is the result of ``hot_keys``
    when the caller has it from a narrower read of the log; its keys are named as in ``log``.
    """
    ks, os = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
    if hot is None:
        hot, count = hot_keys(log.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)]), ks, hot_rows)
    else:
        count = hot[1]
        hot = hot[0].toDF(*[f"__{n}" for n in ks])
    known = log.where(F.col(valid_from).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    rows = known.select(
        *[F.col(k).alias(n) for k, n in zip(keys, ks)],
        F.unix_micros(valid_from).alias("start"),
        *[F.col(o).alias(n) for o, n in zip(order, os)],
        F.col(state).alias("state"),
        (F.unix_micros(ends) if ends else F.lit(None).cast("bigint")).alias("ends"),
    ).where("state IS NOT NULL")
    rows = rows.withColumn("hash", F.unhex(F.md5("state")))
    if not count:
        return _versions(sliced(rows, ks, "start", hot, 0), ks, os, False, keys)
    rows = checkpoint(sliced(rows, ks, "start", hot, count))
    return _versions(rows.where("slice = 0"), ks, os, False, keys).unionByName(_versions(rows.where("slice <> 0"), ks, os, True, keys))


def _versions(rows: DataFrame, ks: list[str], os: list[str], across: bool, keys: list[str]) -> DataFrame:
    order = ["start", *os]
    rows = neighbours(rows, ks, order, F.col("start"), across, after="next")
    rows = rows.withColumn("stop", F.least("next.v", "ends")).where("stop IS NULL OR stop > start").drop("next", "ends")
    # starts are distinct from here on; what is compared is the hash of the version open until then
    rows = neighbours(rows, ks, order, F.struct("stop", "hash"), across, after="next", before="prior")
    goes_on = (F.col("prior.v.stop") == F.col("start")) & (F.col("prior.v.hash") == F.col("hash"))
    rows = rows.withColumn("opens", ~F.coalesce(goes_on, F.lit(False))).withColumn("last", F.col("next").isNull())
    # a version ends where its last row stops: that of the row before the next opening row, or of the key's last row
    kept = rows.where("opens OR last").select(*ks, *order, "slice", "state", "stop", "opens", "last", F.col("prior.v.stop").alias("closed"))
    kept = neighbours(kept, ks, order, F.struct("opens", "closed", "stop"), across, after="then").where("opens")
    end = F.when(F.col("last"), F.col("stop")).when(F.col("then.v.opens"), F.col("then.v.closed")).otherwise(F.col("then.v.stop"))
    return kept.select(*[F.col(n).alias(k) for n, k in zip(ks, keys)], F.col("start").alias("valid_from_us"), end.alias("valid_to_us"), "state")


def merge_updates(current: DataFrame, log: DataFrame, keys: list[str], valid_from: str, order: list[str], state: str, ends: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Type-two merge of a batch of log rows into the ``current`` versions (``keys, valid_from_us, valid_to_us, state``).

    Of each key the newest version meets the batch: where the hash of the next row's state differs, or the version is not
    open until then, it is closed and a new one inserted; where it is equal it goes on. Older versions and those of other
    keys pass through. The result is that of ``history`` over both logs, provided that no row of the batch is older than
    the newest version of its key (late rows need ``history`` over the log of their keys).
    """
    touched = log.select(*keys).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).distinct()
    ranked = current.withColumn("__newest", F.lead("valid_from_us").over(Window.partitionBy(*keys).orderBy("valid_from_us")).isNull())
    hit = ranked.where("__newest").drop("__newest").join(touched, keys, "left_semi")
    rest = ranked.where("NOT __newest").drop("__newest").unionByName(ranked.where("__newest").drop("__newest").join(touched, keys, "left_anti"))
    names = [*keys, *[f"__o{i}" for i in range(len(order))]]
    fresh = log.select(*keys, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], F.col(valid_from).alias("__from"), F.col(state).alias("__state"), (F.col(ends) if ends else F.lit(None).cast("timestamp")).alias("__ends"))
    first = [F.lit(None).cast(fresh.schema[f"__o{i}"].dataType).alias(f"__o{i}") for i in range(len(order))]  # nulls come first
    old = hit.select(*keys, *first, F.timestamp_micros("valid_from_us").alias("__from"), F.col(state).alias("__state"), F.timestamp_micros("valid_to_us").alias("__ends"))
    merged = history(fresh.unionByName(old), keys, "__from", names[len(keys) :], "__state", "__ends", hot_rows)
    return rest.select(*keys, "valid_from_us", "valid_to_us", F.col(state).alias("state")).unionByName(merged)


def merge_snapshot(current: DataFrame, snapshot: DataFrame, keys: list[str], as_of_us: int, state: str = "state") -> DataFrame:
    """One step of a type-two merge: ``current`` versions (``keys, valid_from_us, valid_to_us, state``) and a full
    snapshot (``keys, state``) give the new versions.

    Open versions whose state hash differs from the snapshot's, or whose key is missing there, are closed at
    ``as_of_us``; changed and new keys get an open version from then on; equal ones stay. Closed versions pass through.
    Rows of the snapshot with a null key part or state are left out; of rows with the same key one must be present only.
    """
    snap = snapshot.select(*keys, F.col(state).alias("__new"))
    for k in [*keys, "__new"]:
        snap = snap.where(F.col(k).isNotNull())
    live, closed = current.where("valid_to_us IS NULL"), current.where("valid_to_us IS NOT NULL")
    both = live.join(snap, keys, "full")
    same = F.coalesce((F.xxhash64(F.col(state)) == F.xxhash64("__new")) & (F.col(state) == F.col("__new")), F.lit(False))
    both = both.withColumn("__same", same)
    columns = [*keys, "valid_from_us", "valid_to_us", state]
    kept = both.where("valid_from_us IS NOT NULL").withColumn("valid_to_us", F.when(~F.col("__same"), F.lit(as_of_us).cast("bigint")))
    added = both.where(~F.col("__same") & F.col("__new").isNotNull()).select(
        *keys, F.lit(as_of_us).cast("bigint").alias("valid_from_us"), F.lit(None).cast("bigint").alias("valid_to_us"), F.col("__new").alias(state)
    )
    return closed.select(columns).unionByName(kept.select(columns)).unionByName(added)
