import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import mixing
from loomery.llm.near_duplicates import duplicate_groups, similar_pairs, words_of
from loomery.llm.packing import Packer, pack
from loomery.llm.splitting import split_oversized


def entries(spark, rows):
    return spark.createDataFrame(rows, "id string, content string, tokens string, size int")


def words():
    return words_of([F.col("content")])


def brute(rows, t):
    sets = {i: frozenset((c or "").lower().split()) for i, c, *_ in rows if i}
    ids = sorted(i for i, s in sets.items() if s)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


@pytest.fixture(scope="module")
def edited():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        base = rng.sample(vocabulary, rng.randrange(3, 40))
        rows.append((f"a{i}", " ".join(base), "clash", 1))
        for k in range(rng.randrange(3)):
            other = base[:]
            for _ in range(rng.randrange(len(base) // 4 + 2)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rng.shuffle(other)
            rows.append((f"a{i}-{k}", " ".join(other), None, None))
    rows += [rows[0], ("copy", rows[0][1], None, 0), ("empty", "", None, 0), ("null", None, None, 0), (None, "w1 w2", None, 0), ("long", " ".join(f"x{i}" for i in range(20000)), None, 0)]
    return rows


def test_pairs_equal_brute_force(spark, edited):
    got = {tuple(r) for r in similar_pairs(entries(spark, edited), "id", words(), 0.6).select("id_a", "id_b").collect()}
    assert got == brute(edited, 0.6)


def test_groups_are_the_components(spark, edited):
    got = duplicate_groups(entries(spark, edited), "id", words(), 0.6).collect()
    root = {r.id: r.id for r in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(edited, 0.6):
        root[find(a)] = find(b)
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(find(r.id))
    assert all(len(v) == 1 for v in classes.values()) and len(classes) == len({find(r.id) for r in got})


def test_no_rows(spark):
    assert similar_pairs(entries(spark, []), "id", words(), 0.8).count() == 0
    assert duplicate_groups(entries(spark, []), "id", words(), 0.8).count() == 0


def test_pieces_add_up(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab.\n \r\t,é😀") for _ in range(rng.randrange(400))) for _ in range(60)] + ["x" * 500, None, "", " " * 300, "y " * 3000, "z" * 100 + "\n\n" + "q" * 90]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "id int, t string, piece string")
    got = {}
    for r in split_oversized(df, "t", 100, 10).orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append(r)
    for i, t in enumerate(texts):
        s = (t or "").strip()
        assert (i in got) == (len(s) > 100)
        for k, r in enumerate(got.get(i, [])):
            assert r.piece_no == k and len(r.piece) <= 100 and s[r.start_pos - 1 : r.start_pos - 1 + len(r.piece)] == r.piece
            assert k == 0 or r.piece[:10] == got[i][k - 1].piece[-10:]
            assert r.forced == int(any(len(w) > 100 for w in s.split()))
        if i in got:
            assert "".join(r.piece[10 * (r.piece_no > 0) :] for r in got[i]) == s


def test_packing(spark):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 60, 400)] + [100, 250, 101, 0, -1, None]
    df = spark.createDataFrame([(i, n, "c") for i, n in enumerate(sizes)], "id bigint, n int, container string")
    out = pack(df, "id", "n", 100, windows=4, parts=3).toPandas()
    assert out.groupby("container")["size"].sum().max() <= 100
    assert out.groupby("id")["size"].sum().to_dict() == {i: n for i, n in enumerate(sizes) if n and n > 0}
    assert out.groupby("id").size().to_dict() == {i: -(-n // 100) for i, n in enumerate(sizes) if n and n > 0}
    assert out["container"].nunique() <= 1.1 * out["size"].sum() / 100
    assert pack(df.limit(0), "id", "n", 100, parts=2).count() == 0


@pytest.mark.parametrize("low,high,most", [(1100, 1301, 1.0), (500, 701, 1.14), (300, 2049, 1.06)])
def test_packing_of_awkward_sizes(spark, low, high, most):
    """Only containers still open go up, whatever the sizes; the bound is the number of items over half the capacity or of
    the sum, whichever is more."""
    rng = np.random.default_rng(low)
    sizes = [int(x) for x in rng.integers(low, high, 6000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, n int")
    out = pack(df, "id", "n", 2048, windows=64, parts=4).toPandas()
    least = max(-(-sum(sizes) // 2048), sum(n > 1024 for n in sizes))
    assert out.groupby("container")["size"].sum().max() <= 2048 and len(out) == 6000
    assert out["container"].nunique() <= most * least  # of 500 to 700 three go in one


def test_packer_keeps_few_open():
    p = Packer(10, 2)
    assert [p.place(n) for n in (6, 6, 4, 6, 7, 4)] == [0, 1, 0, 2, 3, 2] and len(p.open) <= 2
    p = Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 10, 10, 3, 4)] == [0, 1, 2, 3, 1, 0]


def test_weights():
    natural = mixing.temperature_weights({"a": 90, "b": 10})
    flat = mixing.temperature_weights({"a": 90, "b": 10}, target_entropy=0.6)
    assert abs(natural["a"] - 0.5) < 1e-6 and abs(mixing.entropy(flat) - 0.6) < 1e-6
    w, total, x = mixing.target_weights({"a": 100, "b": 100}, {"a": 0.8, "b": 0.2}, {"a": 2, "b": 1}, 250)
    assert abs(w["a"] - 0.8) < 1e-9 and abs(total - 250) < 1e-6 and x == 1
    w, total, x = mixing.target_weights({"a": 100, "b": 100}, {"a": 0.8, "b": 0.2}, {"a": 1, "b": 1}, 150)
    assert total * w["a"] <= 100 + 1e-6 and abs(total - 150) < 1e-3 and 0 < x < 1
    w, total, _ = mixing.target_weights({"a": 100, "b": 100, "c": 9}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1, "c": 0}, 100)
    assert "c" not in w and abs(w["a"] - 0.625) < 1e-9 and abs(total - 100) < 1e-6
    assert "b" not in mixing.temperature_weights({"a": 5, "b": 5}, repeats={"a": 1, "b": 0}, total=4)
    sizes = {"a": 800.0, "b": 150.0, "c": 50.0}
    assert abs(mixing.exponent_of(sizes, mixing.temperature_weights(sizes, target_entropy=0.9)) - 0.57) < 0.2


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Wiki", "wiki ", "FORUM", None, "other"]), f"t{i % 900}", rng.randrange(1, 50), "u") for i in range(1000)] + [(5000, "forum", None, 5, "u"), (5001, "forum", "zero", 0, "u")]
    items = spark.createDataFrame(rows, "doc_id bigint, source string, text_key string, size int, uses string")
    targets = spark.createDataFrame([("wiki", 0.5, 1), ("forum", 0.5, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    made = mixing.mix(items, targets, 3000.0, block_rows=20)
    mixed = made.items
    out = mixed.collect()
    most = {"wiki": 1, "forum": 3}
    assert len({r.text_key for r in out}) == len(out) and all(r.uses <= most[r.source] for r in out)
    shares = {r.source: r.actual_share for r in mixing.report(mixed, targets).collect()}
    assert abs(shares["wiki"] - 0.5) < 0.01 and shares["absent"] == 0
    assert made.exponent == 1 and abs(sum(r.size * r.uses for r in out) - 3000) < 150
    warm = mixing.temperature_mix(items, targets, 3000.0, block_rows=20)
    got = {r.source: r.actual_share for r in mixing.report(warm.items, targets).collect()}
    assert all(abs(got[k] - w) < 0.02 for k, w in warm.weights.items()) and abs(warm.exponent) < 1e-6
    assert mixing.mix(items.limit(0), targets).items.count() == 0 and mixing.temperature_mix(items.limit(0), targets).items.count() == 0
    with pytest.raises(ValueError):
        mixing.read_targets(spark.range(mixing.MOST_TARGETS + 1).selectExpr("cast(id as string) source", "0.1D target_share", "1 max_repeats"))
