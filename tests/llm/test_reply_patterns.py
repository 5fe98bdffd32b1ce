import re

from pyspark.sql import functions as F

from loomery.llm import replies

TEXTS = ["Yes. It runs (as v2.5) again:\n- first;  \n- second\r\nand \"third\".", "", "...", "Ünïcode_x1 e.g. a/b-c 12)", "a) b! c?x d.", None]
ITEM = re.compile(r"([\w'’/.\-]*\w)\)?([.!?:;]+(?=\s|$|[\"”»`)])|[ \t]*\r?\n)?")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_no_pattern_for_a_word(spark):
    """p2_found: one pattern finds the words of a text, none is run for each of them; blanks are trimmed without one."""
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    items = rows.select("text", replies._items(F.col("text")).alias("i"))
    assert "regexp_extract(" not in plan(items) and "rlike" not in plan(items)
    for r in items.collect():
        want = None if r.text is None else [(re.sub(r"\d", "9", m[1]), m[2] is not None) for m in ITEM.finditer(r.text)]
        assert (r.i and [tuple(x) for x in r.i]) == (want or r.i)
    edges = spark.createDataFrame([(" \x00 ﻿a b 　",), ("​\t",)], "text string").select(replies._stripped(F.col("text")).alias("t"))
    assert "regexp" not in plan(edges) and [r.t for r in edges.collect()] == ["a b", ""]
