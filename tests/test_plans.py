from datetime import datetime

from loomery.plans import agents, memory


def test_windows_add_up_to_all_rows(spark, tmp_path):
    rows = [(i, i % 3, datetime(2024, 1, 1 + i % 3, 12), "click" if i % 2 else "view", 1.0) for i in range(30)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = agents.stream_windows(spark, str(tmp_path)).collect()
    assert sum(r.rows for r in out) == 30 and len(out) == 6


def test_every_entry_is_a_new_one(spark, tmp_path):
    rows = [(i, f"m{i}", ["user", "a"], "fact", "city", f"City {i}", None, None, None, [f"m{(i + 1) % 3}"]) for i in range(1, 3)] + [(0, "m0", ["user", "a"], "fact", "other", "Nothing", None, None, None, ["m1"])]
    schema = "ord bigint, id string, namespace array<string>, memory_type string, key string, content string, metadata map<string, string>, invalidated_at string, expires_at string, related_ids array<string>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/memory_store.parquet")
    assert {tuple(r) for r in memory.QUERIES["memory_conflicts"](spark, str(tmp_path)).collect()} == {("m1", "m2"), ("m2", "m1")}
    assert {r.id: r.related for r in memory.memory_reverse_links(spark, str(tmp_path)).collect()} == {"m0": "m2,m1", "m1": "m0,m2", "m2": "m1,m0"}
