"""Windows, evaluation, guardrails, traces and streams over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomery.operators import evals as E
from loomery.operators import guardrails as G
from loomery.operators import memory as M
from loomery.operators import traces as R
from loomery.operators import windows as W
from loomery.plans.tables import messages, table
from loomery.plans.texts import MESSAGES
from loomery.session import shared_folder
from loomery.streaming import triggers


def _kept(df, *more):
    return df.select("session_id", "pos", *more)


def window_units(spark, folder):
    return _kept(W.units(messages(spark, folder)), "keep_always", F.col("unit").cast("bigint").alias("unit"))


def window_messages(spark, folder):
    return _kept(W.by_messages(messages(spark, folder), 6))


def window_tokens(spark, folder):
    return _kept(W.by_tokens(messages(spark, folder), 400), "status")


def summary_plan(spark, folder):
    return W.summary_plan(messages(spark, folder), 4, trigger_messages=20, trigger_tokens=900).select("session_id", "reason", "covered", "rows", "tokens")


def session_rollup(spark, folder):
    return W.rollup(messages(spark, folder))


def provider_exchanges(spark, folder):
    return R.exchanges(messages(spark, folder)).select("session_id", "first_pos", "role", "rows", F.md5("content").alias("content_md5"))


def interval_trigger(spark, folder):
    return M.every_nth(messages(spark, folder), ["session_id"], ["pos"], 5).select("session_id", "pos", F.col("seen").cast("bigint").alias("seen"))


def least_messages_trigger(spark, folder):
    return M.at_least(messages(spark, folder), ["session_id"], 4)


def _trials(spark, folder):
    cases = table(spark, folder, "eval_cases").dropDuplicates(["ord"]).select(F.col("id").alias("case_id"), "expected_tools")
    rows = table(spark, folder, "trial_results").dropDuplicates(["ord"]).select("case_id", F.col("trial").cast("bigint").alias("trial"), "tool_calls", "latency_ms")
    return rows.join(cases, "case_id")


def _trajectory(mode):
    def run(spark, folder):
        out = E.trajectory(_trials(spark, folder), "expected_tools", "tool_calls", mode).where("expected_tools IS NOT NULL")
        return out.select("case_id", "trial", "passed", F.round("score", 6).alias("score"), F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))

    run.__name__ = f"trajectory_{mode.replace('-', '_')}"
    return run


def _calls(df, column):
    args = F.create_map(F.lit("place"), (F.col("p") % 2).cast("string"))
    return df.select("case_id", "trial", F.posexplode(column).alias("p", "name")).select("case_id", "trial", F.col("p").alias("pos"), "name", args.alias("args"))


def tool_params(spark, folder):
    rows = _trials(spark, folder)
    out = E.tool_parameters(_calls(rows, "expected_tools"), _calls(rows, "tool_calls"), ["case_id", "trial"])
    return out.withColumn("score", F.round("score", 6))


def _scores(spark, folder):
    rows = _trials(spark, folder)
    path = E.trajectory(rows, "expected_tools", "tool_calls", "any-order").select("case_id", "trial", F.lit("trajectory").alias("dimension"), "passed", "score")
    fast = rows.where("latency_ms IS NOT NULL").select("case_id", "trial", F.lit("latency").alias("dimension"), (F.col("latency_ms") <= 2000).alias("passed"), F.least(F.lit(1.0), F.lit(2000.0) / F.greatest("latency_ms", F.lit(1))).alias("score"))
    return path.where("passed IS NOT NULL").unionByName(fast)


def eval_trials(spark, folder):
    return E.trials(_scores(spark, folder), _trials(spark, folder))


def eval_cases_passed(spark, folder):
    return E.cases(eval_trials(spark, folder))


def eval_pass_rates(spark, folder):
    r = E.rates(eval_trials(spark, folder))
    return r.select(F.round("pass_rate", 6).alias("pass_rate"), F.round("pass_hat_k", 6).alias("pass_hat_k"))


def eval_dimension_avg(spark, folder):
    return E.dimensions(_scores(spark, folder)).withColumn("average", F.round("average", 6))


def eval_failures(spark, folder):
    return E.failures(_scores(spark, folder)).select("case_id", "trial", "dimension", F.round("score", 6).alias("score"))


def pii_detect(spark, folder):
    found = G.labels(F.col("content"), G.PATTERNS)
    return messages(spark, folder).select("ord", F.array_join(found, ",").alias("labels")).where("labels <> ''")


def pii_redact(spark, folder):
    return messages(spark, folder).where("content IS NOT NULL").select("ord", F.md5(G.redacted(F.col("content"), G.PATTERNS)).alias("content_md5"))


def _guards():
    refund = G.Guard("topic", "block", lambda v: F.lower(v).contains("refund"), lambda v: F.lit("topic is closed"))
    return [G.pattern_guard("mail", "transform", {"email": G.EMAIL}, "input"), G.pattern_guard("ssn", "block", {"ssn": G.US_SSN}, "input"), refund]


def _guarded(spark, folder, shadow):
    out = G.chain(messages(spark, folder).where("content IS NOT NULL").select("ord", "content"), "content", _guards(), shadow)
    return out.select("ord", "action", "reason", F.array_join("decisions", ",").alias("decisions"), F.md5("result").alias("result_md5"))


def guard_chain_enforce(spark, folder):
    return _guarded(spark, folder, False)


def guard_chain_shadow(spark, folder):
    return _guarded(spark, folder, True)


def _tools(spark, folder):
    return messages(spark, folder).select("ord", F.posexplode("tool_calls").alias("n", "call")).select("ord", F.col("n").cast("bigint").alias("n"), F.col("call.name").alias("tool"), F.length("call.input").alias("size"))


def tool_permission(spark, folder):
    decision = G.tool_permission(F.col("tool"), ["search_docs", "search_memory", "get_order"], ["send_mail"], {"search_docs": (F.col("size") > 40, "input too long")})
    return _tools(spark, folder).select("ord", "n", decision.alias("d")).select("ord", "n", "d.action", "d.reason")


def approval_needed(spark, folder):
    decision = G.approval(F.col("tool"), {"create_ticket": (F.col("size") > 20, "long ticket"), "send_mail": (F.lit(True), "mail leaves the house")})
    return _tools(spark, folder).select("ord", "n", decision.alias("d")).select("ord", "n", "d.action", "d.reason")


def _events(spark, folder):
    return table(spark, folder, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("duration"))


def run_metrics(spark, folder):
    return R.run_metrics(_events(spark, folder), ["user_id", "day"]).withColumn("total_ms", F.round("total_ms", 4))


def tool_stats(spark, folder):
    return R.tool_stats(_events(spark, folder)).withColumn("avg_ms", F.round("avg_ms", 4))


def stop_reasons(spark, folder):
    runs = R.run_metrics(_events(spark, folder), ["user_id", "day"]).select("user_id", "day", F.col("tool_calls").alias("steps"), F.col("tools").alias("model_calls"), "tool_calls", (F.col("total_ms") / 100).alias("seconds"), F.lit(0).alias("tokens"))
    reason = R.stop_reason(R.Limits(steps=6, model_calls=4, tool_calls=5, seconds=9.0, tokens=100))
    return runs.select("user_id", "day", reason.alias("reason")).where("reason IS NOT NULL")


def retry_schedule(spark, folder):
    return R.retry_schedule(spark)


def _stream(spark, folder):
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        stream = reader.parquet(path)
    else:  # a file is read as the only one of its folder
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _place(spark):
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(spark, stream, mode="append"):
    place = _place(spark)
    return triggers.run_once(stream, f"{place}/state", f"{place}/out", mode)


def stream_interval_trigger(spark, folder):
    points = triggers.threshold_points(_stream(spark, folder), "user_id", "ts", "event_id", "value", 5)
    return _run(spark, points).select("key", "ord", "observed")


def stream_reflection_threshold(spark, folder):
    return _run(spark, triggers.threshold_points(_stream(spark, folder), "user_id", "ts", "event_id", "value", 10, 300.0)).withColumn("total", F.round("total", 6))


def stream_windows(spark, folder):
    return _run(spark, triggers.windowed_counts(_stream(spark, folder), "ts", "event_type", "1 day", "0 seconds"), "complete")


QUERIES = {
    f.__name__: f
    for f in (
        window_units, window_messages, window_tokens, summary_plan, session_rollup, provider_exchanges, interval_trigger, least_messages_trigger, _trajectory("exact"), _trajectory("in-order"), _trajectory("any-order"), tool_params,
        eval_trials, eval_cases_passed, eval_pass_rates, eval_dimension_avg, eval_failures, pii_detect, pii_redact, guard_chain_enforce, guard_chain_shadow, tool_permission, approval_needed,
        run_metrics, tool_stats, stop_reasons, retry_schedule, stream_interval_trigger, stream_reflection_threshold, stream_windows,
    )
}

_TOK = "(4 + CAST(ceil((coalesce(length(content), 0) + coalesce(list_sum([coalesce(length(x.name), 0) + coalesce(length(x.input), 0) FOR x IN tool_calls]), 0)) / 4e0) AS BIGINT))"
_UNITS = f"""m AS (SELECT *, role = 'system' OR coalesce(pinned, false) AS ka, coalesce(role = 'assistant' AND len(tool_calls) > 0, false) AS ct, {_TOK} AS tok FROM {MESSAGES}),
u0 AS (SELECT *, last_value(CASE WHEN role <> 'tool' THEN ct END IGNORE NULLS) OVER (PARTITION BY session_id, ka ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lc FROM m),
u AS (SELECT *, sum(CASE WHEN role = 'tool' AND coalesce(lc, false) THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, ka ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS unit FROM u0),
r AS (SELECT *, sum(1) OVER w AS rows_back, sum(tok) OVER w AS tok_back, max(unit) OVER (PARTITION BY session_id, ka) AS newest FROM u WINDOW w AS (PARTITION BY session_id, ka ORDER BY unit DESC RANGE UNBOUNDED PRECEDING)),
s AS (SELECT *, coalesce(sum(CASE WHEN ka THEN tok END) OVER (PARTITION BY session_id), 0) AS spent, coalesce(max(CASE WHEN NOT ka AND unit = newest THEN tok_back END) OVER (PARTITION BY session_id), 0) AS first FROM r)"""
_TR = "t AS (SELECT t.case_id, t.trial::BIGINT AS trial, t.tool_calls AS a, t.latency_ms, c.expected_tools AS e FROM (SELECT DISTINCT ord, case_id, trial, tool_calls, latency_ms FROM trial_results) t JOIN (SELECT DISTINCT ord, id, expected_tools FROM eval_cases) c ON c.id = t.case_id)"
_HAVE = "len(list_filter({s}, lambda y: y = x))"
_OV = f"coalesce(list_sum([least({_HAVE.format(s='e')}, {_HAVE.format(s='a')}) FOR x IN list_distinct(e)]), 0)"
_MORE = "coalesce(array_to_string(flatten([[x FOR i IN range(greatest(0, len(list_filter({p}, lambda y: y = x)) - len(list_filter({q}, lambda y: y = x))))] FOR x IN list_sort(list_distinct({p}))]), ','), '')"


def _traj_sql(passed: str) -> str:
    return f"""WITH {_TR}, o AS (SELECT *, {_OV} AS o FROM t WHERE e IS NOT NULL), p AS (SELECT *, {passed} AS passed FROM o)
SELECT case_id, trial, passed, round(CASE WHEN passed OR len(e) = 0 THEN 1e0 ELSE o::DOUBLE / len(e) END, 6) AS score, {_MORE.format(p='e', q='a')} AS missing, {_MORE.format(p='a', q='e')} AS extra FROM p"""


_SC = f"""{_TR}, sc AS (SELECT case_id, trial, 'trajectory' AS dimension, {_OV} = len(e) AS passed, CASE WHEN len(e) = 0 THEN 1e0 ELSE {_OV}::DOUBLE / len(e) END AS score FROM t WHERE e IS NOT NULL
UNION ALL SELECT case_id, trial, 'latency', latency_ms <= 2000, least(1e0, 2000e0 / greatest(latency_ms, 1)) FROM t WHERE latency_ms IS NOT NULL),
tp AS (SELECT DISTINCT t.case_id, t.trial, coalesce(p, false) AS passed FROM t LEFT JOIN (SELECT case_id, trial, bool_and(passed) AS p FROM sc GROUP BY ALL) s ON s.case_id = t.case_id AND s.trial = t.trial)"""
_TEXTS = f"(SELECT ord, content AS v FROM {MESSAGES} WHERE content IS NOT NULL)"
_RX = {name: pattern.replace("'", "''") for name, pattern in G.PATTERNS.items()}
_HIT = {name: f"regexp_matches(v, '{rx}')" for name, rx in _RX.items()}
_LABELS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {hit} THEN '{name}' END" for name, hit in _HIT.items()) + "], lambda x: x IS NOT NULL), ',')"
_CLEAN = "v"
for _rx in _RX.values():
    _CLEAN = f"regexp_replace({_CLEAN}, '{_rx}', '[redacted]', 'g')"
_NO_MAIL = f"regexp_replace(v, '{_RX['email']}', '[redacted]', 'g')"


def _chain_sql(seen: str, shadow: bool) -> str:
    ends = "true" if shadow else "NOT b"
    return f"""WITH a AS (SELECT ord, v, {_HIT['email']} AS m, {seen} AS w FROM {_TEXTS}), b AS (SELECT *, regexp_matches(w, '{_RX['ssn']}') AS b, contains(lower(w), 'refund') AS r FROM a),
c AS (SELECT *, {ends} AND r AS t FROM b)
SELECT ord, {"'allow'" if shadow else "CASE WHEN b OR t THEN 'block' WHEN w <> v THEN 'transform' ELSE 'allow' END"} AS action,
{"NULL::VARCHAR" if shadow else "CASE WHEN b THEN 'matched ssn at input' WHEN t THEN 'topic is closed' WHEN w <> v THEN 'redacted email at input' END"} AS reason,
array_to_string(list_filter([CASE WHEN m THEN 'mail:transform' END, CASE WHEN b THEN 'ssn:block' END, CASE WHEN t THEN 'topic:block' END], lambda x: x IS NOT NULL), ',') AS decisions,
{"md5(v)" if shadow else "CASE WHEN NOT (b OR t) THEN md5(w) END"} AS result_md5 FROM c"""


_TOOLS = f"(SELECT ord, unnest(range(len(tool_calls))) AS n, unnest(tool_calls).name AS tool, length(unnest(tool_calls).input) AS size FROM {MESSAGES})"
_EV = "(SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS tool, event_type = 'error' AS bad, value FROM events)"

ORACLE = {
    "window_units": f"WITH {_UNITS} SELECT session_id, pos, ka AS keep_always, unit FROM u",
    "window_messages": f"WITH {_UNITS} SELECT session_id, pos FROM s WHERE ka OR rows_back <= 6 OR unit = newest",
    "window_tokens": f"""WITH {_UNITS}, z AS (SELECT *, CASE WHEN spent > 400 THEN 'preserved_over_budget' WHEN spent + first > 400 THEN 'newest_over_budget' ELSE 'ok' END AS status FROM s)
SELECT session_id, pos, status FROM z WHERE ka OR (status = 'ok' AND spent + tok_back <= 400)""",
    "summary_plan": f"""WITH {_UNITS}, z AS (SELECT *, sum(tok) OVER (PARTITION BY session_id) AS all_tok, count(*) OVER (PARTITION BY session_id) AS ar, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS fe FROM m),
y AS (SELECT *, CASE WHEN all_tok > 900 THEN 'tokens' WHEN ar >= 20 THEN 'messages' END AS reason FROM z)
SELECT session_id, reason, sum(CASE WHEN fe > 4 AND NOT (ka AND NOT coalesce(kind = 'conversation_summary', false)) THEN 1 ELSE 0 END)::BIGINT AS covered, max(ar) AS rows, max(all_tok)::BIGINT AS tokens FROM y WHERE reason IS NOT NULL GROUP BY session_id, reason""",
    "session_rollup": f"""SELECT session_id, count(*) AS messages, sum({_TOK})::BIGINT AS tokens, sum(coalesce(len(tool_calls), 0))::BIGINT AS tool_calls, coalesce(sum(TRY_CAST(metadata['input_tokens'] AS BIGINT)), 0)::BIGINT AS input_tokens,
coalesce(sum(TRY_CAST(metadata['output_tokens'] AS BIGINT)), 0)::BIGINT AS output_tokens FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY ord ORDER BY loaded_at) = 1) GROUP BY session_id""",
    "provider_exchanges": f"""WITH f AS (SELECT *, CASE WHEN role = 'tool' AND lag(role) OVER (PARTITION BY session_id ORDER BY pos) = 'tool' THEN 0 ELSE 1 END AS fresh FROM {MESSAGES}),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT session_id, min(pos) AS first_pos, role, count(*) AS rows, md5(string_agg(coalesce(content, ''), chr(10) ORDER BY pos)) AS content_md5 FROM g GROUP BY session_id, g, role""",
    "interval_trigger": f"SELECT session_id, pos, seen FROM (SELECT session_id, pos, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS seen FROM {MESSAGES}) WHERE seen % 5 = 0",
    "least_messages_trigger": f"SELECT session_id, count(*) AS seen FROM {MESSAGES} GROUP BY session_id HAVING count(*) >= 4",
    "trajectory_exact": _traj_sql("e = a"),
    "trajectory_in_order": _traj_sql("list_reduce(list_prepend(0, list_transform(a, lambda x, i: i)), lambda acc, i: CASE WHEN acc < len(e) AND e[acc + 1] = a[i] THEN acc + 1 ELSE acc END) = len(e)"),
    "trajectory_any_order": _traj_sql("o = len(e)"),
    "tool_params": f"""WITH {_TR}, ex AS (SELECT case_id, trial, p, name, row_number() OVER (PARTITION BY case_id, trial, name ORDER BY p) AS n FROM (SELECT case_id, trial, unnest(range(len(e))) AS p, unnest(e) AS name FROM t)),
ac AS (SELECT case_id, trial, p, name, row_number() OVER (PARTITION BY case_id, trial, name ORDER BY p) AS n FROM (SELECT case_id, trial, unnest(range(len(a))) AS p, unnest(a) AS name FROM t)),
b AS (SELECT ex.case_id, ex.trial, ac.p IS NULL AS gone, coalesce(ex.p % 2 <> ac.p % 2, false) AS wrong FROM ex LEFT JOIN ac USING (case_id, trial, name, n))
SELECT case_id, trial, count(*) AS total, count(*) FILTER (NOT gone AND NOT wrong) AS matched, count(*) FILTER (gone) AS missing_calls, count(*) FILTER (wrong) AS mismatched_fields, count(*) FILTER (gone OR wrong) = 0 AS passed,
round(count(*) FILTER (NOT gone AND NOT wrong)::DOUBLE / count(*), 6) AS score FROM b GROUP BY case_id, trial""",
    "eval_trials": f"WITH {_SC} SELECT case_id, trial, passed FROM tp",
    "eval_cases_passed": f"WITH {_SC} SELECT case_id, bool_and(passed) AS passed, count(*) AS trials FROM tp GROUP BY case_id",
    "eval_pass_rates": f"WITH {_SC} SELECT round((SELECT avg(CASE WHEN passed THEN 1e0 ELSE 0e0 END) FROM tp), 6) AS pass_rate, round(avg(CASE WHEN p THEN 1e0 ELSE 0e0 END), 6) AS pass_hat_k FROM (SELECT case_id, bool_and(passed) AS p FROM tp GROUP BY case_id)",
    "eval_dimension_avg": f"WITH {_SC} SELECT dimension, round(avg(score), 6) AS average, count(*) AS scores FROM sc GROUP BY dimension",
    "eval_failures": f"WITH {_SC} SELECT case_id, trial, dimension, round(score, 6) AS score FROM sc WHERE NOT passed",
    "pii_detect": f"SELECT ord, {_LABELS} AS labels FROM {_TEXTS} WHERE {_LABELS} <> ''",
    "pii_redact": f"SELECT ord, md5({_CLEAN}) AS content_md5 FROM {_TEXTS}",
    "guard_chain_enforce": _chain_sql(_NO_MAIL, False),
    "guard_chain_shadow": _chain_sql("v", True),
    "tool_permission": f"""SELECT ord, n, CASE WHEN tool = 'send_mail' OR tool NOT IN ('search_docs', 'search_memory', 'get_order') OR (tool = 'search_docs' AND size > 40) THEN 'block' ELSE 'allow' END AS action,
CASE WHEN tool = 'send_mail' THEN tool || ' is denied' WHEN tool NOT IN ('search_docs', 'search_memory', 'get_order') THEN tool || ' is not allowed' WHEN tool = 'search_docs' AND size > 40 THEN 'input too long' END AS reason FROM {_TOOLS}""",
    "approval_needed": f"""SELECT ord, n, CASE WHEN (tool = 'create_ticket' AND size > 20) OR tool = 'send_mail' THEN 'confirm' ELSE 'allow' END AS action,
CASE WHEN tool = 'create_ticket' AND size > 20 THEN 'long ticket' WHEN tool = 'send_mail' THEN 'mail leaves the house' END AS reason FROM {_TOOLS}""",
    "run_metrics": f"SELECT user_id, day, count(*) AS tool_calls, count(*) FILTER (bad) AS errors, count(DISTINCT tool) AS tools, round(sum(value), 4) AS total_ms FROM {_EV} GROUP BY user_id, day",
    "tool_stats": f"SELECT tool, count(*) AS calls, count(*) FILTER (bad) AS errors, round(avg(value), 4) AS avg_ms FROM {_EV} GROUP BY tool",
    "stop_reasons": f"""SELECT * FROM (SELECT user_id, day, CASE WHEN count(*) >= 6 THEN 'max_steps' WHEN count(DISTINCT tool) >= 4 THEN 'max_model_calls' WHEN count(*) >= 5 THEN 'max_tool_calls' WHEN sum(value) / 100 > 9 THEN 'max_runtime' END AS reason FROM {_EV} GROUP BY user_id, day) WHERE reason IS NOT NULL""",
    "retry_schedule": "SELECT i AS attempt, d AS delay, d * 0.875e0 AS least, d * 1.125e0 AS most FROM (SELECT unnest(range(1, 6)) AS i, least(2e0, 0.25e0 * pow(2e0, unnest(range(1, 6)) - 1)) AS d)",
    "stream_interval_trigger": "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS ord, 5::BIGINT AS observed FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL) WHERE n % 5 = 0",
}
