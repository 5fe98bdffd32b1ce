import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loomery.errors import ConfigurationError, NamespaceAccessError, UnsupportedFileTypeError
from loomery.functions import text as T
from loomery.functions import tools
from loomery.operators import evals, guardrails, memory, splitters, traces, windows
from loomery.sources import loaders, stores


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t, "kept") for i, t in enumerate(texts)], "id string, text string, chunk_x string")


def chunks(df):
    return [r.chunk for r in df.orderBy("id", "chunk_index").collect()]


def test_text(spark):
    df = spark.createDataFrame([("Python, RAG & Browser-Automation!", "Straße  X ")], "a string, b string")
    row = df.select(T.words(F.col("a")).alias("w"), T.folded(F.col("b")).alias("f"), T.overlap(F.col("a"), F.lit("python only")).alias("o"), T.strip(F.col("b")).alias("s")).first()
    assert row.w == ["python", "rag", "browser", "automation"] and row.f == "strasse x" and row.o == 0.25 and row.s == "Straße  X"


def test_splitters(spark):
    df = docs(spark, "Backend engineer role.\n\nPython and RAG required.", None, "  ")
    assert chunks(splitters.recursive_character(df, "id", "text", 30, 0)) == ["Backend engineer role.", "Python and RAG required."]
    assert chunks(splitters.recursive_character(docs(spark, "alpha beta gamma delta"), "id", "text", 12, 4, (" ",))) == ["alpha beta", "beta gamma", "amma delta"]
    assert chunks(splitters.recursive_character(docs(spark, "abcdef"), "id", "text", 3, 0)) == ["a b", "c d", "e f"]
    assert chunks(splitters.recursive_text(docs(spark, "aa bb cc"), "id", "text", 5, 0)) == ["aa bb", "cc"]
    assert chunks(splitters.fixed(docs(spark, "abcdefghij"), "id", "text", 4, 1)) == ["abcd", "defg", "ghij"]
    md = splitters.markdown(docs(spark, "intro\n# CV\nx\n## Exp\ny\n# Skills\nz"), "id", "text").orderBy("chunk_index").collect()
    assert [r.heading_path for r in md] == [[], ["CV"], ["CV", "Exp"], ["Skills"]]
    page = "<h1>Job</h1><script>var t='</p>';</script><section><p>One <b>two</b></p><p>One <b>two</b></p></section>"
    got = splitters.html(docs(spark, page), "id", "text").orderBy("chunk_index").collect()
    assert [(r.chunk, r.tag) for r in got] == [("Job", "h1"), ("One two", "p"), ("One two One two", "section")]
    assert docs(spark, page).select(splitters.html_to_text(F.col("text"))).first()[0] == "Job\nOnetwo\nOnetwo"
    with pytest.raises(ConfigurationError):
        splitters.fixed(df, "id", "text", 5, 5)


def test_windows(spark):
    call = [("t1", "f", "{}")]
    rows = [("s", 0, "system", "sys", [], False), ("s", 1, "user", "x" * 40, [], False), ("s", 2, "assistant", "a", call, False), ("s", 3, "tool", "r" * 20, [], None), ("s", 4, "user", "u", [], False)]
    df = spark.createDataFrame([(*r, None) for r in rows], "session_id string, pos int, role string, content string, tool_calls array<struct<tool_use_id:string,name:string,input:string>>, pinned boolean, kind string")
    kept = lambda d: sorted(r.pos for r in d.collect())
    assert kept(windows.by_messages(df, 1)) == [0, 4]
    assert kept(windows.by_messages(df, 2)) == [0, 4]
    assert kept(windows.by_messages(df, 3)) == [0, 2, 3, 4]
    assert kept(windows.by_tokens(df, 12)) == [0, 4]
    assert windows.by_tokens(df, 4).first().status == "preserved_over_budget"
    assert windows.by_tokens(df, 7).first().status == "newest_over_budget"
    assert kept(windows.by_messages(df.limit(0), 2)) == []
    with pytest.raises(ConfigurationError):
        windows.validate(1, 1)


def test_evals(spark):
    cases = [(["a", "b"], ["a", "b"], True, True, True), (["a", "b"], ["a", "x", "b"], False, True, True), (["a", "b"], ["b", "a"], False, False, True), (["a", "a"], ["a"], False, False, False), ([], ["x"], False, True, True)]
    df = spark.createDataFrame([(i, e, a) for i, (e, a, *_) in enumerate(cases)], "i int, e array<string>, a array<string>")
    for mode, k in (("exact", 2), ("in-order", 3), ("any-order", 4)):
        assert [r.passed for r in evals.trajectory(df, "e", "a", mode).orderBy("i").collect()] == [c[k] for c in cases]
    more = evals.trajectory(df, "e", "a", "any-order").where("i = 3").first()
    assert more.missing == ["a"] and more.score == 0.5
    expected = spark.createDataFrame([(1, 0, "refund", {"id": "7"}), (1, 1, "mail", {}), (2, 0, "refund", {"id": "7"})], "c int, pos int, name string, args map<string,string>")
    actual = spark.createDataFrame([(1, 0, "refund", {"id": "8"}), (2, 0, "refund", {"id": "7", "x": "y"})], "c int, pos int, name string, args map<string,string>")
    got = {r.c: (r.passed, r.score, r.missing_calls, r.mismatched_fields) for r in evals.tool_parameters(expected, actual, ["c"]).collect()}
    assert got == {1: (False, 0.0, 1, 1), 2: (True, 1.0, 0, 0)}
    verdicts = evals.judged(spark.createDataFrame([("good",), ("bad",), (None,)], "p string"), "p", lambda t: '```json\n{"passed": true, "score": 3}```' if t == "good" else "no").collect()
    assert [(r.passed, r.score) for r in verdicts] == [(True, 1.0), (None, None), (None, None)]


def test_guardrails(spark):
    df = spark.createDataFrame([("charge 4111 1111 1111 1111 to a@b.co",), ("fine",), (None,)], "v string")
    card = guardrails.pattern_guard("card", "block", {"credit_card": guardrails.CREDIT_CARD}, "input")
    mail = guardrails.pattern_guard("mail", "transform", {"email": guardrails.EMAIL}, "input")
    got = guardrails.chain(df, "v", [mail, card]).collect()
    assert [(r.action, r.result) for r in got] == [("block", None), ("allow", "fine"), ("allow", None)]
    shadow = guardrails.chain(df, "v", [mail, card], shadow=True).first()
    assert shadow.action == "allow" and shadow.decisions == ["mail:transform", "card:block"] and shadow.result == "charge 4111 1111 1111 1111 to a@b.co"
    policy = spark.createDataFrame([("x",), ("send",), ("pay",), ("ok",)], "t string").select(guardrails.tool_permission(F.col("t"), ["x", "pay", "ok"], ["x"], {"pay": (F.lit(True), "too much")}).alias("d"))
    assert [r.d.action for r in policy.collect()] == ["block", "block", "block", "allow"]


ENTRY = "id string, memory_type string, namespace array<string>, key string, content string, created_at timestamp, expires_at timestamp, invalidated_at timestamp, importance double, related_ids array<string>, metadata map<string,string>, ord bigint"


def entry(spark, *rows):
    base = {"memory_type": "preference", "namespace": ["user", "a"], "key": "k", "content": "c", "importance": None, "related_ids": [], "metadata": {}}
    out = []
    for i, r in enumerate(rows):
        r = base | r
        out.append((r.get("id", f"e{i}"), r["memory_type"], r["namespace"], r["key"], r["content"], None, None, None, r["importance"], r["related_ids"], r["metadata"], i))
    return spark.createDataFrame(out, ENTRY).withColumn("created_at", F.lit("2025-01-01").cast("timestamp"))


def test_memory(spark):
    old = entry(spark, {"content": "Likes  TEA"}, {"key": "z", "metadata": {"subject": "Tea"}, "content": "x"}, {"namespace": ["other"]})
    new = entry(spark, {"id": "n1", "content": "likes tea"}, {"id": "n2", "content": "likes coffee"}, {"id": "n3", "key": "q", "metadata": {"name": "tea"}, "content": "y"})
    got = {tuple(r) for r in memory.conflicts(new, old, "2025-06-01").collect()}
    assert got == {("n2", "e0"), ("n3", "e1")}
    found = entry(spark, {"content": "User likes direct technical notes.", "importance": 0.9, "key": "style"}, {"content": "nothing"})
    asked = spark.createDataFrame([(1, ["user"], None, "technical notes", 3, None)], "query_id int, namespace array<string>, memory_type string, query string, limit int, min_importance double")
    hit = memory.lexical_search(asked, found, "2025-06-01").collect()
    assert [(r.id, round(r.score, 6)) for r in hit] == [("e0", round(0.7 + 0.27, 6))]
    with pytest.raises(NamespaceAccessError):
        memory.NamespacePolicy(["user"]).enforce(old)
    assert memory.NamespacePolicy(["user"]).visible(old).count() == 2
    assert memory.reflection_points(entry(spark, *[{"importance": 1.0}] * 7)).collect()[0].observed == 3
    replies = spark.createDataFrame([('say {"records": [{"operation": "create", "memory_type": "odd", "key": "user.style", "content": "x", "importance": "7"}, {"operation": "invalidate", "key": "old"}]} end',)], "reply string")
    kept, gone = memory.extracted(replies, "reply")
    assert [(r.memory_type, r.importance) for r in kept.collect()] == [("semantic", 1.0)] and [r.key for r in gone.collect()] == ["old"]


def test_loaders_and_stores(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "cv.md").write_text("# CV")
    (tmp_path / "sub" / "letter.TXT").write_text("Dear")
    (tmp_path / "shot.png").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:document>')
    got = {r.metadata["file_name"]: (r.content, r.metadata["mime_type"]) for r in loaders.files(spark, str(tmp_path)).collect()}
    assert got == {"cv.md": ("# CV", "text/markdown"), "letter.TXT": ("Dear", "text/plain"), "a.docx": ("One\nTwo", loaders.DOCX_TYPE)}
    with pytest.raises(UnsupportedFileTypeError):
        loaders.files(spark, str(tmp_path), ignore_unsupported=False)
    (tmp_path / "set.json").write_text('{"name": "n", "cases": [{"id": "1", "question": "q", "metadata": {"a": "b"}}]}')
    case = loaders.eval_dataset(spark, str(tmp_path / "set.json")).first()
    assert (case.dataset_version, case.id, case.reference, case.metadata) == ("v0", "1", None, {"a": "b"})
    page = loaders.pages(spark.createDataFrame([("u",)], "url string"), lambda u: (b"<p>caf\xe9</p>", "text/html; charset=latin-1")).first()
    assert (page.content, page.mime_type) == ("café", "text/html")
    log = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("a", "3", 3)], "id string, content string, ord int").withColumn("metadata", F.create_map().cast("map<string,string>")).withColumn("v", F.col("ord"))
    assert [(r.id, r.content) for r in stores.listed(stores.upserted(log, "id", ["v"]), {"kind": None}).collect()] == [("a", "3"), ("b", "2")]


def test_tools_and_limits(spark):
    def f(a: str, b: int, c: list[float], d: bool = True, e=None):
        return a, b, c, d, e

    assert tools.json_schema(f)["required"] == ["a", "b", "c"] and tools.json_schema(f)["properties"]["c"] == {"type": "array", "items": {"type": "number"}}
    assert tools.struct_type(f).simpleString() == "struct<a:string,b:bigint,c:array<double>,d:boolean,e:string>"
    runs = spark.createDataFrame([(1, 5, 0, 0.5, 0), (9, 5, 0, 0.5, 0), (1, 0, 0, 9.0, 0)], "steps int, model_calls int, tool_calls int, seconds double, tokens int")
    assert [r[0] for r in runs.select(traces.stop_reason(traces.Limits(steps=4, model_calls=5, seconds=8))).collect()] == ["max_model_calls", "max_steps", "max_runtime"]


def test_nothing_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(splitters.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "loomery.llm" in p.read_text()]


def test_scores_overflow_and_verdicts(spark):
    rows = [(1.5, 0.0, "Error: CONTEXT_LENGTH_EXCEEDED"), (0.5, None, "please reduce the length"), (0.5, 2.0, "exceeds the limit of refunds"), (-1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "r double, i double, m string")
    got = df.select(T.blend(F.col("r"), F.col("i")).alias("b"), T.is_overflow(F.col("m")).alias("o")).collect()
    assert [round(g.b, 9) for g in got] == [0.7, 0.5, 0.65, 0.3] and [g.o for g in got] == [True, True, False, None]
    assert evals.verdict('{"passed": "false"}') is None and evals.verdict("[]") is None and evals.verdict(None) is None
    assert evals.verdict('```json\n{"passed": false, "reason": " x "}\n```') == (False, 0.0, "x")
