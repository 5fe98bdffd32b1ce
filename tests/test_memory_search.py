import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest

from loomery.operators import memory as M
from loomery.plans import memory


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    names = [["user", "a"], ["user", "a", "x"], ["user", "b"], ["user"], ["team", "c"]]
    rows = []
    for i in range(400):
        words = " ".join(rng.choice("red green blue café naïve one_two three".split()) for _ in range(rng.randrange(1, 6)))
        about = {"source": "chat", "extracted_by": "llm"} if i % 2 else None
        gone = datetime(2025, 3, 1) if i % 9 == 0 else None
        rows.append((i, f"m{i}", rng.choice(names), rng.choice(M.TYPES), f"k{i % 7}", words if i % 100 else "zzzé", about, gone, None, [], rng.choice([None, 0.2, 0.9]), datetime(2025, 2, 1) + timedelta(hours=rng.randrange(5000)), datetime(2025, 9, 20)))
    rows.append(rows[5])
    schema = "ord bigint, id string, namespace array<string>, memory_type string, key string, content string, metadata map<string, string>, invalidated_at timestamp, expires_at timestamp, related_ids array<string>, importance double, created_at timestamp, loaded_at timestamp"
    path = str(tmp_path_factory.mktemp("memory"))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/memory_store.parquet")
    return path


@pytest.mark.parametrize("name", ["memory_hybrid_routed", "memory_multi_store", "memory_search_filtered"])
def test_searches_equal_their_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW memory_store AS SELECT * FROM read_parquet('{folder}/memory_store.parquet/*.parquet')")
    cut = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert cut(memory.QUERIES[name](spark, folder).collect()) == cut(con.sql(memory.ORACLE[name]).fetchall())


def test_an_entry_is_read_once_for_a_namespace(spark, folder):
    """However many queries ask in it."""
    asked = memory.entries(spark, folder).selectExpr("ord query_id", "namespace", "cast(null as string) memory_type", "content query", "5 limit")
    stored = M.searched(memory.entries(spark, folder), memory.AS_OF)
    assert M.searched(stored, memory.AS_OF) is stored
    assert M.in_scopes(asked, stored).count() <= 3 * stored.count() < M.matching(asked, memory.entries(spark, folder), memory.AS_OF).count()
