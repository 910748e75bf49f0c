"""Registered queries: conversations, event streams in batch form, cache, metrics, prompts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import prompts
from codequarry.functions import text as tx
from codequarry.operators import cache, metrics, packing
from codequarry.operators import chunks as ck
from codequarry.operators import evidence as ev
from codequarry.operators import sessions as ss
from codequarry.operators.topk import top_k
from codequarry.options import DEFAULTS
from codequarry.plans import corpora as co
from codequarry.plans.corpus_queries import SQL_SNAPSHOTS, snapshot_pair
from codequarry.plans.evidence_queries import pick
from codequarry.plans.registry import query
from codequarry.sources import event_log
from codequarry.sources.tables import load

_TYPES = ["delta", "status", "delta", "evidence", "delta", "delta", "status", "delta", "delta", "complete", "delta", "error"]


def k_of(props):
    return F.get_json_object(props, "$.k").cast("int")


SQL_K = "(props->>'$.k')::INT"


def envelopes(spark, sf):
    return shape_envelopes(load(spark, sf, "events"))


def shape_envelopes(events):
    """events as envelopes: one request per user and event type, jobs and seq from the payload."""
    k = k_of(F.col("props"))
    return events.select(
        "event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("request_id"),
        F.col("ts").alias("arrived"), F.concat(F.lit("j"), k % 5).alias("job_id"),
        (F.floor(F.unix_seconds("ts") / 3600) % 400 + k % 7 - 3).cast("int").alias("seq"),
        F.when(k == 99, "complete").otherwise(pick(_TYPES[:9], k)).alias("type"), F.col("props").alias("text"),
    )


SQL_ENVELOPES = f"""env AS (SELECT event_id, user_id || ':' || event_type AS request_id, ts AS arrived, 'j' || {SQL_K} % 5 AS job_id,
   (floor(epoch(ts) / 3600)::BIGINT % 400 + {SQL_K} % 7 - 3)::INT AS seq,
   CASE WHEN {SQL_K} = 99 THEN 'complete' ELSE {_TYPES[:9]!r}[{SQL_K} % 9 + 1] END AS type, props AS text
  FROM events),
own AS (SELECT e.* FROM env e JOIN (SELECT request_id, arg_min(job_id, (arrived, seq)) AS j FROM env GROUP BY 1) o
   ON o.request_id = e.request_id AND o.j = e.job_id WHERE seq >= 0),
growing AS (SELECT * FROM (SELECT *, max(seq) OVER (PARTITION BY request_id ORDER BY arrived, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM own)
   WHERE seq > coalesce(prev, -1)),
accepted AS (SELECT g.* FROM growing g LEFT JOIN (SELECT request_id, min((arrived, seq)) AS fin FROM growing WHERE type = 'complete' GROUP BY 1) t
   USING (request_id) WHERE fin IS NULL OR (arrived, seq) <= fin)"""


@query("envelope_gate", f"WITH {SQL_ENVELOPES} SELECT event_id, request_id, job_id, seq, type FROM accepted")
def envelope_gate(spark, sf):
    return ss.envelope_gate(envelopes(spark, sf)).select("event_id", "request_id", "job_id", "seq", "type")


@query("job_phases", f"""WITH {SQL_ENVELOPES} SELECT request_id, max(seq) AS last_seq, count(*) AS accepted,
  CASE WHEN arg_max(type, seq) = 'complete' THEN 'complete' ELSE 'running' END AS phase FROM accepted GROUP BY 1""")
def job_phases(spark, sf):
    return ss.job_phase(ss.envelope_gate(envelopes(spark, sf)))


@query("delta_assembly", f"""WITH {SQL_ENVELOPES} SELECT request_id, CASE seq % 3 WHEN 0 THEN 's1' WHEN 1 THEN 'doc.py' ELSE 'answer' END AS scope,
  string_agg(text, '' ORDER BY seq) AS text FROM accepted WHERE type = 'delta' GROUP BY ALL""")
def delta_assembly(spark, sf):
    part = F.col("seq") % 3
    scope = ss.scope_of(
        F.when(part == 0, "segment:s1").when(part == 1, "").otherwise(None), F.when(part == 1, "doc.py"), F.lit("answer")
    )
    deltas = ss.envelope_gate(envelopes(spark, sf)).filter("type = 'delta'").withColumn("scope", scope)
    return ss.assemble_deltas(deltas)


@query("committed_entries", """WITH jobs AS (SELECT user_id || '-' || event_id // 100 AS job_id, event_type, event_id, props FROM events)
SELECT job_id, event_id, props FROM jobs WHERE event_type = 'view'
  AND job_id IN (SELECT job_id FROM jobs WHERE event_type = 'purchase')""")
def committed_entries(spark, sf):
    jobs = load(spark, sf, "events").withColumn(
        "job_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 100).cast("string"))
    )
    ended = jobs.withColumn("type", F.when(F.col("event_type") == "purchase", "complete").otherwise("status"))
    return cache.complete_jobs_only(jobs.filter("event_type = 'view'"), ended).select("job_id", "event_id", "props")


@query("event_log_parse", f"""WITH raw AS (SELECT event_id, user_id, {SQL_K} AS k, event_type FROM events),
e AS (SELECT *, CASE event_type WHEN 'click' THEN 'delta' WHEN 'view' THEN 'status' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'complete' ELSE 'telemetry' END AS type FROM raw)
SELECT event_id, 'j' || user_id AS job_id, k - 5 AS seq, type, CASE WHEN k % 17 = 0 THEN 'malformed' WHEN k < 5 THEN 'bad_seq' WHEN type = 'telemetry' THEN 'unknown_type'
  WHEN k % 13 = 0 THEN 'type_mismatch' WHEN type = 'error' OR (type = 'delta' AND k % 2 = 1) THEN 'bad_payload' ELSE '' END AS problem FROM e WHERE k % 17 <> 0
UNION ALL SELECT event_id, NULL, NULL, NULL, 'malformed' FROM e WHERE k % 17 = 0""")
def event_log_parse(spark, sf):
    k = k_of(F.col("props"))
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "delta").when(kind == "view", "status").when(kind == "error", "error")
        .when(kind == "signup", "complete").otherwise("telemetry")
    )
    payload = F.when(k % 2 == 1, '{"text":"a","state":"x","code":"c"}').otherwise('{"text":"a","target":"t","state":"x"}')
    data = F.concat(
        F.lit('{"job_id":"j'), "user_id", F.lit('","seq":'), (k - 5).cast("string"), F.lit(',"type":"'), name,
        F.lit('","scope_id":"f.py","payload":'), payload, F.lit("}"),
    )
    line = F.concat(
        F.lit("event: "), F.when(k % 13 == 0, "ping").otherwise(name), F.lit("\ndata: "),
        F.when(k % 17 == 0, F.lit('{"job_id": 3, oops')).otherwise(data),
    )
    records = load(spark, sf, "events").select("event_id", line.alias("value"))
    good = F.col("problem").isNull() | (F.col("problem") != "malformed")
    return event_log.parse(records).select(
        "event_id", *[F.when(good, F.col(f"envelope.{c}")).alias(c) for c in ("job_id", "seq", "type")],
        F.coalesce("problem", F.lit("")).alias("problem"),
    )


@query("citation_filter", """WITH said AS (SELECT conv_id, turn, replace(replace(text, '.', ' [E' || (turn + 1) || '].'), ',', ' [E' || (conv_id % 6) || '] [Ex] [E,') AS t FROM conversations),
marks AS (SELECT *, regexp_extract_all(t, '\\[E\\d+\\]') AS m FROM said)
SELECT conv_id, turn, regexp_replace(t, '\\[E(0|4|5|6|7|8|9)\\]', '', 'g') AS text,
  array_to_string(list_sort(list_filter(list_distinct(list_transform(m, lambda x: x[2:-2])), lambda x: x NOT IN ('E1', 'E2', 'E3'))), ',') AS invalid FROM marks""")
def citation_filter(spark, sf):
    marked = F.replace("text", F.lit("."), F.concat(F.lit(" [E"), F.col("turn") + 1, F.lit("].")))
    marked = F.replace(marked, F.lit(","), F.concat(F.lit(" [E"), F.col("conv_id") % 6, F.lit("] [Ex] [E,")))
    valid = F.array(F.lit("E1"), F.lit("E2"), F.lit("E3"))
    rows = load(spark, sf, "conversations").select("conv_id", "turn", ev.filter_citations(marked, valid).alias("r"))
    return rows.select("conv_id", "turn", F.col("r.text").alias("text"), F.array_join("r.invalid", ",").alias("invalid"))


@query("uncited_footer", """WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' [E2]' WHEN turn % 3 = 1 THEN text ELSE '' END AS t,
  CASE WHEN turn = 4 THEN [] ELSE list_transform(range(1, conv_id % 8 + 2), lambda i: '[E' || i || '] f' || i || '.py:1-' || i) END AS loc FROM conversations)
SELECT conv_id, turn, CASE WHEN t <> '' AND len(loc) > 0 AND NOT regexp_matches(t, '\\[E\\d+\\]') THEN t || chr(10) || chr(10) || '证据定位：' || array_to_string(loc[1:5], '；') ELSE t END AS answer FROM a""")
def uncited_footer(spark, sf):
    turn = F.col("turn") % 3
    text = F.when(turn == 0, F.concat("text", F.lit(" [E2]"))).when(turn == 1, F.col("text")).otherwise("")
    numbers = F.sequence(F.lit(1), (F.col("conv_id") % 8 + 1).cast("int"))
    locators = F.transform(numbers, lambda i: F.concat(F.lit("[E"), i, F.lit("] f"), i, F.lit(".py:1-"), i))
    some = F.when(F.col("turn") == 4, F.filter(locators, lambda _l: F.lit(False))).otherwise(locators)
    return load(spark, sf, "conversations").select("conv_id", "turn", ev.append_footer(text, some).alias("answer"))


SQL_SESSIONS = """gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session_no FROM gaps),
sess AS (SELECT user_id, session_no, min(ts) AS started, max(ts) AS updated, count(*) AS events FROM numbered GROUP BY ALL)"""


@query("sessions", f"""WITH {SQL_SESSIONS} SELECT user_id, session_no, epoch_us(started) AS started_us, epoch_us(updated) AS updated_us, events FROM sess""")
def sessions(spark, sf):
    return ss.sessions(load(spark, sf, "events")).select(
        "user_id", "session_no", F.unix_micros("started").alias("started_us"), F.unix_micros("updated").alias("updated_us"),
        "events",
    )


@query("live_sessions", f"""WITH {SQL_SESSIONS} SELECT user_id, session_no, epoch_us(updated) AS updated_us FROM sess
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, session_no DESC) <= 64""")
def live_sessions(spark, sf):
    return ss.live_sessions(ss.sessions(load(spark, sf, "events"))).select(
        "user_id", "session_no", F.unix_micros("updated").alias("updated_us")
    )


@query("anchor_merge", f"""WITH a AS (SELECT user_id AS conversation_id, event_id AS ord, replace('src\\f' || {SQL_K} % 30, '\\', '/') AS path, {SQL_K} % 4 AS start_line,
   {SQL_K} % 6 AS end_line, CASE WHEN {SQL_K} % 2 = 0 THEN event_type END AS symbol, 'h' || event_id % 5 AS source_hash FROM events),
newest AS (SELECT conversation_id, path, start_line, end_line, symbol, arg_max(source_hash, ord) AS source_hash, max(ord) AS ord FROM a
   WHERE start_line >= 1 AND end_line >= start_line GROUP BY ALL)
SELECT conversation_id, path, start_line, end_line, symbol, source_hash, ord FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ord DESC) AS rn FROM newest) WHERE rn <= 16""")
def anchor_merge(spark, sf):
    k = k_of(F.col("props"))
    anchors = load(spark, sf, "events").select(
        F.col("user_id").alias("conversation_id"), F.col("event_id").alias("ord"),
        F.concat(F.lit("src\\f"), (k % 30).cast("string")).alias("path"), (k % 4).alias("start_line"), (k % 6).alias("end_line"),
        F.when(k % 2 == 0, F.col("event_type")).alias("symbol"), F.concat(F.lit("h"), F.col("event_id") % 5).alias("source_hash"),
    )
    return ss.merge_anchors(anchors)


def messages(spark, sf):
    return load(spark, sf, "conversations").select(
        F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content")
    )


@query("last_messages", """SELECT conversation_id, turn, age, content FROM (SELECT conv_id AS conversation_id, turn, text AS content,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations WHERE role IN ('user', 'assistant') AND text <> '') WHERE age <= 3""")
def last_messages(spark, sf):
    return ss.last_messages(messages(spark, sf), 3).select("conversation_id", "turn", "age", "content")


@query("checkpoint_summaries", """WITH s AS (SELECT conv_id AS conversation_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age
  FROM conversations WHERE role IN ('user', 'assistant') AND text <> '')
SELECT conversation_id, left(string_agg(role || ': ' || left(text, 160), '；' ORDER BY turn), 300) AS summary FROM s WHERE age > 3 GROUP BY 1""")
def checkpoint_summaries(spark, sf):
    return ss.checkpoint_summaries(messages(spark, sf), 3, 160, 300)


@query("redacted_events", """SELECT conv_id, turn, CASE role WHEN 'system' THEN 'tool_result' ELSE role END AS kind,
  CASE WHEN role <> 'system' THEN text END AS content, CASE WHEN role <> 'system' THEN text END AS items FROM conversations""")
def redacted_events(spark, sf):
    rows = load(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", "tool_result").otherwise(F.col("role")).alias("kind"),
        F.col("text").alias("content"), F.col("text").alias("items"),
    )
    return ss.redact(rows)


@query("fresh_history", f"""WITH {SQL_SNAPSHOTS},
msg AS (SELECT conv_id, turn, unnest([{{d: conv_id * 11 + turn, h: 1}}, {{d: conv_id + turn, h: turn % 2}}]) AS a FROM conversations WHERE role = 'assistant'),
hash_at AS (SELECT file_id, n.source_hash AS cur, sha256(CASE WHEN file_id % 10 IN (1, 3) THEN content || '?' ELSE content END) AS seen FROM now n),
stale AS (SELECT DISTINCT conv_id, turn FROM msg LEFT JOIN hash_at ON file_id = a.d WHERE file_id IS NULL OR (a.h = 1 AND cur <> seen))
SELECT conv_id, turn, s.conv_id IS NOT NULL AS stale FROM conversations LEFT JOIN stale s USING (conv_id, turn)""")
def fresh_history(spark, sf):
    files = co.files(spark, sf).select("file_id", "path", "source_hash", "content")
    seen = F.sha2(F.when(F.col("file_id") % 10 == 1, F.concat("content", F.lit("?"))).when(
        F.col("file_id") % 10 == 3, F.concat("content", F.lit("?"))).otherwise(F.col("content")), 256)
    said = load(spark, sf, "conversations").withColumn("message_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    cited = said.filter("role = 'assistant'").select(
        "message_id", F.posexplode(F.array(F.col("conv_id") * 11 + F.col("turn"), F.col("conv_id") + F.col("turn"))).alias("n", "file_id"),
        "turn",
    )
    known = cited.join(files.select("file_id", "path", seen.alias("seen")), "file_id", "left")
    anchors = known.select(
        "message_id", F.coalesce("path", F.lit("gone")).alias("path"),
        F.when((F.col("n") == 0) | (F.col("turn") % 2 == 1), F.coalesce("seen", F.lit("-"))).otherwise("").alias("source_hash"),
    ).groupBy("message_id").agg(F.collect_list(F.struct("path", "source_hash")).alias("anchors"))
    _, stale = ev.stale_messages(anchors, files)
    marked = said.join(stale.withColumn("stale", F.lit(True)), "message_id", "left")
    return marked.select("conv_id", "turn", F.coalesce("stale", F.lit(False)).alias("stale"))


@query("context_pressure", """WITH b AS (SELECT conv_id, sum(greatest(1, length(text) // 3))::BIGINT AS base_tokens FROM conversations GROUP BY 1),
f AS (SELECT conv_id, base_tokens, base_tokens >= 750 AS compacting, base_tokens + 200 >= 900 AS drop_checkpoint FROM b)
SELECT f.*, (SELECT count(*) FROM conversations c WHERE c.conv_id = f.conv_id AND c.role IN ('user', 'assistant') AND text <> '') AS said,
  CASE WHEN drop_checkpoint THEN least(4, (SELECT count(*) FROM conversations c WHERE c.conv_id = f.conv_id AND c.role IN ('user', 'assistant') AND text <> ''))
   ELSE (SELECT count(*) FROM conversations c WHERE c.conv_id = f.conv_id AND c.role IN ('user', 'assistant') AND text <> '') END AS history FROM f""")
def context_pressure(spark, sf):
    said = messages(spark, sf)
    base = said.groupBy(F.col("conversation_id").alias("conv_id")).agg(
        F.sum(tx.estimate_tokens(F.col("content"))).alias("base_tokens"),
        F.count_if(F.col("role").isin("user", "assistant") & (F.col("content") != "")).alias("said"),
    )
    flagged = base.select("*", *packing.pressure(F.col("base_tokens"), 200, 1000, DEFAULTS.soft_ratio, DEFAULTS.hard_ratio))
    return flagged.withColumn("history", F.when(F.col("drop_checkpoint"), F.least(F.lit(4), "said")).otherwise(F.col("said")))


@query("call_caps", """WITH calls AS (SELECT user_id || '-' || ts::DATE AS session, least(extract(hour FROM ts) // 8, 2) AS step, event_id, event_type FROM events),
first3 AS (SELECT *, row_number() OVER (PARTITION BY session, step ORDER BY event_id) AS n FROM calls QUALIFY n <= 3),
early AS (SELECT *, row_number() OVER (PARTITION BY session, event_type ORDER BY step, n) <= 2 AS runs FROM first3 WHERE step < 2),
used AS (SELECT session, count(*) FILTER (runs) AS u FROM early GROUP BY 1),
late AS (SELECT f.*, f.n <= least(3, 8 - coalesce(u, 0)) AS considered, (SELECT count(*) FROM early e WHERE e.session = f.session AND e.event_type = f.event_type AND e.runs) AS before
  FROM first3 f LEFT JOIN used USING (session) WHERE step = 2)
SELECT session, step, event_id AS ord, event_type AS signature, runs FROM early
UNION ALL SELECT session, step, event_id, event_type, considered AND before + row_number() OVER (PARTITION BY session, event_type ORDER BY n) <= 2 FROM late""")
def call_caps(spark, sf):
    calls = load(spark, sf, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
        F.floor(F.hour("ts") / 8).alias("step"), F.col("event_id").alias("ord"), F.col("event_type").alias("signature"),
    )
    return packing.cap_calls(calls, DEFAULTS.same_call_limit, DEFAULTS.parallel_reads, DEFAULTS.tool_calls)


@query("report_merge", f"""WITH r AS (SELECT event_type AS project_id, 'f' || user_id % 60 AS path, event_id AS ord, 'h' || {SQL_K} // 34 AS source_hash, 's' || {SQL_K} % 4 AS segment, props AS text FROM events),
cur AS (SELECT project_id, path, arg_max(source_hash, ord) AS h, max(ord) AS last_ord FROM r GROUP BY ALL),
brk AS (SELECT r.project_id, r.path, max(ord) AS b FROM r JOIN cur USING (project_id, path) WHERE source_hash <> h GROUP BY ALL),
recent AS (SELECT project_id, path FROM cur QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY last_ord DESC, path) <= 128)
SELECT r.project_id, r.path, source_hash, last_ord, segment, arg_max(text, ord) AS text FROM r JOIN cur c ON c.project_id = r.project_id AND c.path = r.path AND c.h = r.source_hash
  JOIN recent n ON n.project_id = r.project_id AND n.path = r.path
  LEFT JOIN brk b ON b.project_id = r.project_id AND b.path = r.path WHERE ord > coalesce(b.b, -1) GROUP BY ALL""")
def report_merge(spark, sf):
    k = k_of(F.col("props"))
    records = load(spark, sf, "events").select(
        F.col("event_type").alias("project_id"), F.concat(F.lit("f"), F.col("user_id") % 60).alias("path"),
        F.col("event_id").alias("ord"), F.concat(F.lit("h"), F.floor(k / 34).cast("string")).alias("source_hash"),
        F.concat(F.lit("s"), k % 4).alias("segment"), F.col("props").alias("text"),
    )
    return ss.merge_reports(records)


# --- cache ------------------------------------------------------------------------------------


def explanations(spark, sf):
    k = k_of(F.col("props"))
    return load(spark, sf, "events").select(
        cache.make_key(F.lit("segment"), F.col("user_id"), F.col("event_type"), k % 3).alias("key"),
        F.concat(F.lit("f"), F.col("user_id") % 40).alias("file_path"), F.lit("segment").alias("kind"),
        F.when(k % 10 == 0, F.lit("  ")).otherwise(F.col("props")).alias("content"), F.lit("m").alias("model"),
        F.col("event_id").alias("created_at"),
    )


SQL_CACHE = f"""entries AS (SELECT sha256('segment|' || user_id || '|' || event_type || '|' || {SQL_K} % 3) AS key, user_id, event_type, {SQL_K} % 3 AS m,
   'f' || user_id % 40 AS file_path, CASE WHEN {SQL_K} % 10 = 0 THEN '  ' ELSE props END AS content, event_id AS created_at FROM events),
cache AS (SELECT key, arg_max(file_path, created_at) AS file_path, arg_max(content, created_at) AS content, max(created_at) AS created_at FROM entries WHERE trim(content) <> '' GROUP BY 1)"""


@query("cache_table", f"WITH {SQL_CACHE} SELECT * FROM cache")
def cache_table(spark, sf):
    return cache.put(explanations(spark, sf)).select("key", "file_path", "content", "created_at")


@query("cache_lookup", f"""WITH {SQL_CACHE}, wanted AS (SELECT DISTINCT key, user_id || ':' || event_type AS item FROM entries WHERE m < 2)
SELECT item, arg_max(key, created_at) AS key, arg_max(content, created_at) AS content FROM wanted JOIN cache USING (key) GROUP BY 1""")
def cache_lookup(spark, sf):
    k = k_of(F.col("props"))
    wanted = load(spark, sf, "events").filter(k % 3 < 2).select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("item"),
        cache.make_key(F.lit("segment"), F.col("user_id"), F.col("event_type"), k % 3).alias("key"),
    ).distinct()
    return cache.get_newest(cache.put(explanations(spark, sf)), wanted, "item")


@query("cache_deletions", f"""WITH {SQL_CACHE}, rest AS (SELECT * FROM cache WHERE key NOT IN (SELECT key FROM entries WHERE event_type = 'error')
   AND file_path NOT IN (SELECT 'f' || c_custkey FROM customer WHERE c_acctbal < 3000))
SELECT count(*) AS entries, coalesce(sum(length(content)), 0)::BIGINT AS chars FROM rest""")
def cache_deletions(spark, sf):
    kept = cache.put(explanations(spark, sf))
    errors = load(spark, sf, "events").filter("event_type = 'error'").select(
        cache.make_key(F.lit("segment"), F.col("user_id"), F.col("event_type"), k_of(F.col("props")) % 3).alias("key")
    )
    files = load(spark, sf, "customer").filter("c_acctbal < 3000").select(F.concat(F.lit("f"), "c_custkey").alias("file_path"))
    return cache.stats(cache.delete_files(cache.delete_keys(kept, errors), files))


@query("request_cache_keys", """SELECT conv_id, turn, sha256('segment|v3|qwen|t0|' || 'src/f' || conv_id || '.py|' || CASE WHEN turn % 2 = 0 THEN 'detailed' ELSE 'simple' END || '|' || sha256(text) || '|'
  || '[{"content":' || to_json('code: ' || text)::VARCHAR || ',"role":"user"}]') AS key FROM conversations""")
def request_cache_keys(spark, sf):
    body = prompts.canonical(F.array(prompts.message("user", F.concat(F.lit("code: "), "text"))))
    return load(spark, sf, "conversations").select(
        "conv_id", "turn",
        cache.request_key(
            F.lit("segment"), F.lit("v3"), F.lit("qwen"), F.lit("t0"), F.concat(F.lit("src\\f"), "conv_id", F.lit(".py")),
            F.when(F.col("turn") % 2 == 0, "detailed").otherwise("verbose"), F.sha2("text", 256), body,
        ).alias("key"),
    )


# --- metrics ----------------------------------------------------------------------------------


@query("generation_metrics", f"""WITH g AS (SELECT event_type AS task, ts, event_id, value AS queue_ms, value * 2 AS ttft_ms, CASE WHEN user_id % 10 = 0 THEN 0.0::DOUBLE ELSE value * 10 END AS duration_ms,
   {SQL_K} AS output_tokens, {SQL_K} * 7 AS context_tokens, {SQL_K} % 4 = 0 AS cache_hit FROM events),
last AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts DESC, event_id DESC) AS rn FROM g QUALIFY rn <= 500)
SELECT task, count(*) AS count, round_even(count(*) FILTER (cache_hit) / count(*), 4) AS cache_hit_rate, round_even(median(queue_ms), 2) AS median_queue_ms,
  round_even(median(ttft_ms), 2) AS median_ttft_ms, round_even(median(duration_ms), 2) AS median_duration_ms, round_even(median(context_tokens), 2) AS median_context_tokens,
  round_even(median(output_tokens), 2) AS median_output_tokens,
  coalesce(round_even(median(CASE WHEN NOT cache_hit AND duration_ms > 0 THEN output_tokens / (duration_ms / 1000) END), 2), 0) AS median_tokens_per_second FROM last GROUP BY 1""")
def generation_metrics(spark, sf):
    recent = metrics.rolling(generation_samples(load(spark, sf, "events")), ["task"], [F.col("ts").desc(), F.col("event_id").desc()])
    return metrics.generation_metrics(recent, ["task"])


def generation_samples(events):
    """events as samples of generations; the same for a table and a stream."""
    k = k_of(F.col("props"))
    return events.select(
        F.col("event_type").alias("task"), "ts", "event_id", F.col("value").alias("queue_ms"), (F.col("value") * 2).alias("ttft_ms"),
        F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(F.col("value") * 10).alias("duration_ms"),
        k.alias("output_tokens"), (k * 7).alias("context_tokens"), (k % 4 == 0).alias("cache_hit"),
    )


@query("index_metrics", f"""WITH g AS (SELECT user_id % 5 AS host, ts, event_id, value AS duration_ms, {SQL_K} AS files, ({SQL_K} % 6 = 0)::INT AS failed FROM events),
last AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) AS rn FROM g QUALIFY rn <= 500)
SELECT host, count(*) AS count, round_even(median(duration_ms), 2) AS median_duration_ms, sum(files)::BIGINT AS files, sum(failed)::BIGINT AS failed FROM last GROUP BY 1""")
def index_metrics(spark, sf):
    k = k_of(F.col("props"))
    samples = load(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("host"), "ts", "event_id", F.col("value").alias("duration_ms"), k.alias("files"),
        (k % 6 == 0).cast("int").alias("failed"),
    )
    return metrics.index_metrics(metrics.rolling(samples, ["host"], [F.col("ts").desc(), F.col("event_id").desc()]), ["host"])


# --- prompts and reports ----------------------------------------------------------------------


@query("token_estimates", """SELECT doc_id, greatest(1, length(text) // 3) AS tokens, length(text) // 4 AS map_tokens FROM documents""")
def token_estimates(spark, sf):
    return co.files(spark, sf).select(
        F.col("file_id").alias("doc_id"), tx.estimate_tokens(F.col("content")).alias("tokens"),
        F.floor(F.length("content") / 4).alias("map_tokens"),
    )


@query("prompt_rows", f"""WITH {co.SQL_LINED},
h AS (SELECT conv_id, list({{content: text, role: role}} ORDER BY turn) AS hist FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age
   FROM conversations WHERE role IN ('user', 'assistant') AND text <> '') WHERE age <= 8 GROUP BY 1)
SELECT file_id, sha256('explain' || chr(10) || '下面是文件 ' || path || ' 的完整内容：' || chr(10) || chr(10) || '```' || language || chr(10) || content || chr(10) || '```') AS overview_hash,
  sha256('segment' || chr(10) || '该文件的总览：o' || CASE WHEN lines[1] <> '' THEN chr(10) || chr(10) || '该文件的导入依赖：' || chr(10) || '```' || language || chr(10) || lines[1] || chr(10) || '```' ELSE '' END || chr(10) || chr(10)
   || '现在请解读文件 ' || path || ' 第 1~' || line_count || ' 行的「t」：' || chr(10) || chr(10) || '```' || language || chr(10) || content || chr(10) || '```') AS segment_hash,
  sha256('chat' || chr(10) || '【代码上下文】' || chr(10) || '当前正在阅读的文件：' || path || chr(10) || 'ok' || chr(10)
    || coalesce(array_to_string(list_transform(hist, lambda m: m.content), chr(10)) || chr(10), '') || 'why?') AS chat_hash
FROM lined LEFT JOIN h ON conv_id = file_id""")
def prompt_rows(spark, sf):
    history = ss.last_messages(messages(spark, sf)).groupBy("conversation_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "content", "role"))), lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))).alias("history")
    )
    rows = co.file_lines(spark, sf).join(history, F.col("conversation_id") == F.col("file_id"), "left")
    none = F.lit(None).cast("string")
    empty = F.from_json(F.lit("[]"), "array<struct<content string, role string>>")
    overview = prompts.overview_messages("explain", F.col("path"), F.col("content"), F.lit("完整内容"), F.col("language"), none)
    segment = prompts.segment_messages(
        "segment", F.col("path"), F.lit("o"), F.try_element_at("lines", F.lit(1)), F.lit("function"), F.lit("t"), F.lit(1),
        F.col("line_count"), F.col("content"), F.col("language"), none,
    )
    chat = prompts.chat_messages("chat", F.col("path"), none, F.coalesce("history", empty), F.lit("why?"), "ok")

    def digest(built):
        return F.sha2(F.array_join(F.transform(built, lambda m: m["content"]), "\n"), 256)

    return rows.select(
        "file_id", digest(overview).alias("overview_hash"), digest(segment).alias("segment_hash"), digest(chat).alias("chat_hash")
    )


def report_text(segments, explained):
    """One Markdown report per file. segments: path, language, line_count, segment rows; explained: text, mode."""
    rows = segments.join(explained, ["path", "segment_no"], "left")
    suffix = F.when(F.col("mode") == "detailed", "（逐行）").otherwise("")
    body = F.concat(
        F.lit("## "), "title", F.lit("（第 "), "start_line", F.lit("~"), "end_line", F.lit(" 行）"), suffix, F.lit("\n\n```"), "language",
        F.lit("\n"), "code", F.lit("\n```\n\n"), F.coalesce("text", F.lit("（尚未生成解读）")), F.lit("\n"),
    )
    done, total = F.count("text"), F.count("*")
    grouped = rows.groupBy("path", "line_count").agg(
        ev.joined(body, F.col("segment_no"), "\n").alias("body"), done.alias("done"), total.alias("total")
    )
    head = F.concat(
        F.lit("# "), F.substring_index("path", "/", -1), F.lit(" 代码解读\n\n- 文件路径：`"), "path", F.lit("`\n- 文件行数："), "line_count",
        F.lit(" 行，共 "), "total", F.lit(" 段\n- 解读覆盖率："), "done", F.lit("/"), "total", F.lit(" 段（"),
        metrics.coverage_percent(F.col("done"), F.col("total")), F.lit("%）\n\n## 文件总览\n\n（尚未生成）\n\n"),
    )
    return grouped.select("path", "done", "total", F.concat(head, "body").alias("report"))


@query("markdown_reports", f"""WITH {co.SQL_LINED},
seg AS (SELECT *, unnest(range(0, (line_count + 3) // 4)) AS n FROM lined),
said AS (SELECT s.*, CASE WHEN l.quality = 1 AND n % 2 = 0 THEN 'quality ' || quality END AS text, CASE WHEN toxic = 1 THEN 'detailed' ELSE 'simple' END AS mode
  FROM seg s LEFT JOIN labels l ON l.doc_id = s.file_id),
g AS (SELECT path, line_count, count(text) AS done, count(*) AS total, string_agg('## t' || n || '（第 ' || (n * 4 + 1) || '~' || least(n * 4 + 4, line_count) || ' 行）'
   || CASE WHEN text IS NOT NULL AND mode = 'detailed' THEN '（逐行）' ELSE '' END || chr(10) || chr(10) || '```' || language || chr(10) || array_to_string(lines[n * 4 + 1 : n * 4 + 4], chr(10)) || chr(10) || '```'
   || chr(10) || chr(10) || coalesce(text, '（尚未生成解读）') || chr(10), chr(10) ORDER BY n) AS body FROM said GROUP BY ALL)
SELECT path, done, total, '# ' || string_split(path, '/')[-1] || ' 代码解读' || chr(10) || chr(10) || '- 文件路径：`' || path || '`' || chr(10) || '- 文件行数：' || line_count || ' 行，共 ' || total || ' 段' || chr(10)
  || '- 解读覆盖率：' || done || '/' || total || ' 段（' || round_even(done * 100 / total, 0)::INT || '%）' || chr(10) || chr(10) || '## 文件总览' || chr(10) || chr(10) || '（尚未生成）' || chr(10) || chr(10) || body AS report FROM g""")
def markdown_reports(spark, sf):
    files = co.file_lines(spark, sf).filter("line_count > 0")
    last = F.floor((F.col("line_count") - 1) / 4).cast("int")
    rows = files.withColumn("segment_no", F.explode(F.sequence(F.lit(0), last)))
    segments = rows.select(
        "path", "language", "line_count", "segment_no", F.concat(F.lit("t"), "segment_no").alias("title"),
        (F.col("segment_no") * 4 + 1).alias("start_line"), F.least(F.col("segment_no") * 4 + 4, "line_count").alias("end_line"),
        tx.join_lines(F.slice("lines", F.col("segment_no") * 4 + 1, F.lit(4))).alias("code"), "file_id",
    )
    labels = load(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("file_id"), "quality", "toxic")
    explained = segments.filter("segment_no % 2 = 0").join(labels, "file_id").select(
        "path", "segment_no", F.concat(F.lit("quality "), "quality").alias("text"),
        F.when(F.col("toxic") == 1, "detailed").otherwise("simple").alias("mode"),
    )
    return report_text(segments.drop("file_id"), explained)
