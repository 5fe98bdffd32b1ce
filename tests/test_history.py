import itertools
import random

from pyspark.sql import functions as F

from loomery.operators.history import attribute_state, history, merge_snapshot, merge_updates, with_state

SCHEMA = "k string, s bigint, ord bigint, state string, e bigint, slice string"


def brute(rows):
    out = []
    rows = sorted({r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None}, key=lambda r: (r[0], r[1], r[2]))
    for k, group in itertools.groupby(rows, key=lambda r: r[0]):
        g, versions = list(group), []
        for i, (_, s, _, state, e, *_) in enumerate(g):
            stops = [x for x in ((g[i + 1][1] if i + 1 < len(g) else None), e) if x is not None]
            stop = min(stops) if stops else None
            if stop is not None and stop <= s:
                continue
            if versions and versions[-1][1] == s and versions[-1][2] == state:
                versions[-1][1] = stop
            else:
                versions.append([s, stop, state])
        out += [(k, s, e, state) for s, e, state in versions]
    return sorted(out, key=str)


def run(spark, rows, hot_rows):
    log = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_micros("s")).withColumn("inv", F.timestamp_micros("e"))
    got = history(log, ["k"], "at", ["ord"], "state", "inv", hot_rows)
    return sorted([tuple(r) for r in got.select("k", "valid_from_us", "valid_to_us", "state").collect()], key=str)


def test_history_equals_brute_force_with_and_without_slices(spark):
    rng, day = random.Random(4), 86_400_000_000
    rows = []
    for i in range(400):
        s = rng.randrange(60) * day
        rows.append((rng.choice(["a", "a", "b", "c", None]), s, i, rng.choice(["x", "y", None, "x"]), rng.choice([None, None, s + rng.randrange(-1, 9) * day]), "clash"))
    rows += rows[:20]
    assert run(spark, rows, 10**9) == brute(rows)
    assert run(spark, rows, 20) == brute(rows)


def test_merged_batches_equal_one_log(spark):
    rng, day = random.Random(9), 86_400_000_000
    rows = []
    for i in range(300):
        s = rng.randrange(60) * day
        rows.append((rng.choice(["a", "b", "c", None]), s, i, rng.choice(["x", "y", None]), rng.choice([None, None, s + rng.randrange(-1, 40) * day]), "clash"))
    log = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_micros("s")).withColumn("inv", F.timestamp_micros("e"))
    current = history(log.where(f"s < {20 * day}"), ["k"], "at", ["ord"], "state", "inv")
    for a, b in ((20, 21), (21, 99)):
        current = merge_updates(current, log.where(f"s >= {a * day} AND s < {b * day}"), ["k"], "at", ["ord"], "state", "inv")
    assert sorted([tuple(r) for r in current.collect()], key=str) == brute(rows)


def test_history_of_nothing(spark):
    assert run(spark, [], 5) == []


def test_attribute_state(spark):
    data = ['{"metadata":{"attributes":{"b":1,"a":null}}}', '{"metadata": {"attributes": {"b": 1.0}}}', '{"metadata":{"attributes":{"b":"1"}}}', "[1]", '{"a":', None, "{}"]
    got = [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d string").orderBy("i").select(attribute_state(F.col("d"))).collect()]
    assert got[0] == got[1] != got[2]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d string")
    assert {r.i: r.state for r in with_state(df, "d").collect()} == {i: g for i, g in enumerate(got) if g is not None}
    equal = [["1", "1.0", "1e0", "1.000"], ["1e-13", "0.0000000000001"], ["2e-13"], ["100", "1e2"], ["1e20", "100000000000000000000"], ["-0.0", "0"], ["1.5", "1.50"], ["1e-60"], ["1e60"], ['"1"'], ["true"]]
    flat = [(k, f'{{"metadata":{{"attributes":{{"a":{n}}}}}}}') for k, group in enumerate(equal) for n in group]
    states = {}
    for k, r in zip((k for k, _ in flat), spark.createDataFrame(flat, "k int, d string").select(attribute_state(F.col("d")).alias("s")).collect()):
        states.setdefault(k, set()).add(r.s)
    assert all(len(v) == 1 for v in states.values()) and len(set.union(*states.values())) == len(equal)
    assert got[3] is None and got[4] is None and got[5] is None and got[6] == "[]"


def test_merge_snapshot(spark):
    current = spark.createDataFrame([("a", 1, None, "x"), ("b", 1, None, "y"), ("c", 0, 1, "old"), ("d", 1, None, "z")], "k string, valid_from_us bigint, valid_to_us bigint, state string")
    snapshot = spark.createDataFrame([("a", "x"), ("b", "new"), ("e", "first"), (None, "q")], "k string, state string")
    got = {tuple(r) for r in merge_snapshot(current, snapshot, ["k"], 9).collect()}
    assert got == {("a", 1, None, "x"), ("b", 1, 9, "y"), ("b", 9, None, "new"), ("c", 0, 1, "old"), ("d", 1, 9, "z"), ("e", 9, None, "first")}
