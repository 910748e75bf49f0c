"""Registered queries: evidence rules, packing and budgets.

Every document is a request whose evidence are its own lines, so each list is bounded by one
document; relation, resolution and score follow from the line number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import intents
from codequarry.functions import text as tx
from codequarry.operators import chunks as ck
from codequarry.operators import evidence as ev
from codequarry.operators import fusion, packing
from codequarry.operators.topk import top_k
from codequarry.options import DEFAULTS
from codequarry.plans import corpora as co
from codequarry.plans.corpus_queries import _ASK, SQL_SNAPSHOTS, snapshot_pair
from codequarry.plans.graph_queries import SQL_SITES, sites
from codequarry.plans.registry import query
from codequarry.sources.tables import load

_RESOLUTIONS = ["exact", "anchor", "ambiguous_candidate", "enclosing", "none", "anchor"]


def pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def line_evidence(spark, sf):
    rows = co.line_rows(spark, sf)
    n = F.col("line_no")
    name = F.regexp_extract("line", "^[A-Za-z_][A-Za-z0-9_]*", 0)
    return rows.select(
        F.col("file_id").alias("request_id"), n.alias("ord"), "path", n.alias("start_line"), n.alias("end_line"),
        F.col("line").alias("content"), "source_hash", "language",
        pick(list(fusion.RELATIONS), n + F.col("file_id")).alias("relation"),
        F.when(name != "", name).alias("symbol"),
        F.round(1.0 - (n % 17) * 0.03, 2).alias("score"),
        pick(_RESOLUTIONS, n + F.col("file_id")).alias("resolution"),
        (F.col("file_id") * co.LINE_STRIDE + n).alias("symbol_id"),
    )


SQL_EVIDENCE = f"""{co.SQL_LINE_ROWS},
ev AS (SELECT file_id AS request_id, line_no AS ord, path, line_no AS start_line, line_no AS end_line, line AS content, source_hash, language,
  {list(fusion.RELATIONS)!r}[(line_no + file_id) % 5 + 1] AS relation,
  CASE WHEN regexp_extract(line, '^[A-Za-z_][A-Za-z0-9_]*') <> '' THEN regexp_extract(line, '^[A-Za-z_][A-Za-z0-9_]*') END AS symbol,
  round(1.0::DOUBLE - (line_no % 17) * 0.03::DOUBLE, 2) AS score, {_RESOLUTIONS!r}[(line_no + file_id) % 6 + 1] AS resolution,
  file_id * {co.LINE_STRIDE} + line_no AS symbol_id FROM line_rows)"""
SQL_TIER = "CASE relation WHEN 'definition' THEN 0 WHEN 'reference' THEN 1 WHEN 'caller' THEN 2 WHEN 'callee' THEN 3 ELSE 4 END"


@query("evidence_validation", f"""WITH {SQL_EVIDENCE},
bad AS (SELECT request_id, ord, path, start_line, end_line + CASE WHEN ord % 7 = 2 THEN 5000 ELSE 0 END AS end_line,
   content || CASE WHEN ord % 7 = 1 THEN '!' ELSE '' END AS content, CASE WHEN ord % 7 = 0 THEN 'old' ELSE source_hash END AS h FROM ev)
SELECT b.request_id, b.ord, coalesce(l.source_hash = b.h AND b.start_line >= 1 AND b.end_line <= l.line_count
   AND array_to_string(l.lines[b.start_line:b.end_line], chr(10)) = b.content, FALSE) AS valid
FROM bad b LEFT JOIN lined l USING (path)""")
def evidence_validation(spark, sf):
    kind = F.col("ord") % 7
    rows = line_evidence(spark, sf)
    tampered = rows.withColumn("end_line", F.when(kind == 2, F.col("end_line") + 5000).otherwise(F.col("end_line")))
    tampered = tampered.withColumn("content", F.when(kind == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    tampered = tampered.withColumn("source_hash", F.when(kind == 0, F.lit("old")).otherwise(F.col("source_hash")))
    return ev.validate(tampered, co.file_lines(spark, sf)).select("request_id", "ord", "valid")


@query("priority_dedupe", f"""WITH {SQL_EVIDENCE},
r AS (SELECT *, ord % 4 + 1 AS s, ord % 4 + 1 + ord % 2 AS e, CASE WHEN resolution IN ('exact', 'enclosing') THEN 4
   WHEN resolution = 'ambiguous_candidate' THEN 3 WHEN resolution = 'anchor' THEN 2 ELSE 0 END AS prio FROM ev)
SELECT request_id, path, s AS start_line, e AS end_line, relation, arg_max(resolution, (prio, score, -ord)) AS resolution,
   arg_max(ord, (prio, score, -ord)) AS ord, min(ord) AS slot FROM r GROUP BY ALL""")
def priority_dedupe(spark, sf):
    rows = line_evidence(spark, sf).withColumn("start_line", F.col("ord") % 4 + 1)
    rows = rows.withColumn("end_line", F.col("start_line") + F.col("ord") % 2)
    return ev.prefer_resolved(rows).select(
        "request_id", "path", "start_line", "end_line", "relation", "resolution", "ord", "slot"
    )


@query("stable_evidence_ids", f"""WITH {SQL_EVIDENCE},
k AS (SELECT request_id, path, ord % 4 + 1 AS start_line, source_hash, relation, symbol, min(ord) AS first_ord FROM ev GROUP BY ALL)
SELECT request_id, start_line, relation, symbol, first_ord,
  'E' || row_number() OVER (PARTITION BY request_id ORDER BY first_ord) AS evidence_id FROM k""")
def stable_evidence_ids(spark, sf):
    rows = line_evidence(spark, sf).withColumn("start_line", F.col("ord") % 4 + 1).withColumn("end_line", F.col("start_line"))
    return ev.stable_ids(rows).select("request_id", "start_line", "relation", "symbol", "first_ord", "evidence_id")


@query("evidence_prompt", f"""WITH {SQL_EVIDENCE}
SELECT request_id, '{ev.PROMPT_HEAD}' || string_agg('[E' || ord || '] ' || path || ':' || start_line || '-' || end_line || ' · ' || relation
   || CASE WHEN coalesce(symbol, '') <> '' THEN ' · ' || symbol ELSE '' END || chr(10) || content, chr(10) || chr(10) ORDER BY ord) AS prompt
FROM ev GROUP BY request_id""")
def evidence_prompt(spark, sf):
    return ev.prompt_text(line_evidence(spark, sf).withColumn("evidence_id", F.concat(F.lit("E"), "ord")))


def word_lines(spark, sf):
    """Documents with one word per line: spans long enough to split."""
    content = F.replace("content", F.lit(" "), F.lit("\n"))
    rows = co.files(spark, sf).withColumn("content", content)
    return rows.withColumn("line_count", F.size(tx.lines_of(F.col("content"))))


SQL_WORDS = f"""{co.SQL_FILES},
words AS (SELECT file_id, path, content, {co.sql_lines('content')} AS lines FROM (
   SELECT file_id, path, replace(content, ' ', chr(10)) AS content FROM files))"""


@query("fragment_split", f"""WITH {SQL_WORDS},
span AS (SELECT *, file_id % 50 + 1 AS first, len(lines) AS n FROM words),
cut AS (SELECT *, CASE WHEN n > 120 THEN unnest(range(0, n, 100)) END AS f FROM span WHERE n > 120
  UNION ALL SELECT *, NULL FROM span WHERE n <= 120)
SELECT file_id, f // 100 AS continuation_index, first + coalesce(f, 0) AS start_line,
  CASE WHEN f IS NULL THEN first + n - 1 ELSE first + least(f + 100, n) - 1 END AS end_line,
  sha256(CASE WHEN f IS NULL THEN content ELSE array_to_string(lines[f + 1 : f + 100], chr(10)) END) AS content_hash,
  round(CASE WHEN f IS NULL THEN 0.9::DOUBLE ELSE greatest(0.0::DOUBLE, 0.9::DOUBLE - (f // 100) * 0.002::DOUBLE) END, 6) AS score FROM cut""")
def fragment_split(spark, sf):
    first = F.col("file_id") % 50 + 1
    spans = word_lines(spark, sf).select(
        "file_id", "path", first.alias("start_line"), (first + F.col("line_count") - 1).alias("end_line"), "content",
        F.lit(0.9).alias("score"),
    )
    return packing.fragments(spans).select(
        "file_id", "continuation_index", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"),
        F.round("score", 6).alias("score"),
    )


@query("definition_windows", f"""WITH {SQL_WORDS},
span AS (SELECT file_id, file_id % 50 + 1 AS s, len(lines) AS n, CASE WHEN file_id % 3 > 0 THEN file_id % 50 + 1 + file_id * 13 % (len(lines) + 40) END AS focus FROM words),
raw AS (SELECT file_id, s, 0 AS a, least(79, n - 1) AS b, n FROM span WHERE n > 200
  UNION ALL SELECT file_id, s, greatest(0, n - 35), n - 1, n FROM span WHERE n > 200
  UNION ALL SELECT file_id, s, greatest(0, focus - s - 45), least(n - 1, focus - s + 45), n FROM span WHERE n > 200 AND focus BETWEEN s AND s + n - 1),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY file_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM raw),
grp AS (SELECT *, (sum(fresh) OVER (PARTITION BY file_id ORDER BY a, b))::BIGINT AS g FROM marked),
merged AS (SELECT file_id, s, g - 1 AS idx, min(a) AS a, max(b) AS b FROM grp GROUP BY ALL)
SELECT file_id, idx AS window_no, s + a AS start_line, s + b AS end_line FROM merged
UNION ALL SELECT file_id, 0, s, s + n - 1 FROM span WHERE n <= 200""")
def definition_windows(spark, sf):
    start = (F.col("file_id") % 50 + 1).cast("int")
    focus = F.when(F.col("file_id") % 3 > 0, (start + F.col("file_id") * 13 % (F.col("line_count") + 40)).cast("int"))
    spans = word_lines(spark, sf).select(
        "file_id", start.alias("s"), (start + F.col("line_count") - 1).alias("e"), focus.alias("focus")
    )
    windows = packing.definition_windows(F.col("s"), F.col("e"), F.col("focus"))
    return spans.select("file_id", "s", F.posexplode(windows).alias("window_no", "w")).select(
        "file_id", "window_no", (F.col("s") + F.col("w.a")).alias("start_line"), (F.col("s") + F.col("w.b")).alias("end_line")
    )


@query("token_packing", f"""WITH RECURSIVE {SQL_EVIDENCE},
items AS (SELECT request_id, ord, row_number() OVER (PARTITION BY request_id ORDER BY {SQL_TIER}, score DESC, lower(path), start_line, ord) AS rn,
   '[' || relation || '] ' || path || ':' || start_line || '-' || end_line || CASE WHEN coalesce(symbol, '') <> '' THEN ' · ' || symbol ELSE '' END
     || chr(10) || content AS block FROM ev),
fold AS (SELECT request_id, 0::BIGINT AS rn, 0::BIGINT AS used, 0 AS kept, FALSE AS fits, NULL::BIGINT AS ord, NULL::VARCHAR AS block FROM (SELECT DISTINCT request_id FROM ev)
  UNION ALL
  SELECT f.request_id, i.rn, CASE WHEN greatest(1, (f.used + length(i.block) + CASE WHEN f.kept > 0 THEN 2 ELSE 0 END) // 3) <= 500
         THEN f.used + length(i.block) + CASE WHEN f.kept > 0 THEN 2 ELSE 0 END ELSE f.used END,
    f.kept + (greatest(1, (f.used + length(i.block) + CASE WHEN f.kept > 0 THEN 2 ELSE 0 END) // 3) <= 500)::INT,
    greatest(1, (f.used + length(i.block) + CASE WHEN f.kept > 0 THEN 2 ELSE 0 END) // 3) <= 500, i.ord, i.block
  FROM fold f JOIN items i ON i.request_id = f.request_id AND i.rn = f.rn + 1)
SELECT request_id, coalesce(string_agg(ord::VARCHAR, ',' ORDER BY rn) FILTER (fits), '') AS kept,
  coalesce(string_agg(ord::VARCHAR, ',' ORDER BY rn) FILTER (rn > 0 AND NOT fits), '') AS omitted,
  sha256(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY rn) FILTER (fits), '')) AS text_hash,
  least(500, greatest(1, max(used) // 3)) AS evidence_tokens,
  CASE WHEN count(*) FILTER (rn > 0 AND NOT fits) > 0 THEN '受 token 预算限制，已省略 ' || count(*) FILTER (rn > 0 AND NOT fits) || ' 条证据' ELSE '' END AS warning
FROM fold GROUP BY request_id""")
def token_packing(spark, sf):
    packed = packing.pack(line_evidence(spark, sf), 1000, 300, 150, 50)
    return packed.select(
        "request_id", F.array_join(F.transform("kept", lambda v: v.cast("string")), ",").alias("kept"),
        F.array_join(F.transform("omitted", lambda v: v.cast("string")), ",").alias("omitted"),
        F.sha2("text", 256).alias("text_hash"), "evidence_tokens", "warning",
    )


@query("hard_limit_trim", f"""WITH {SQL_EVIDENCE},
run AS (SELECT request_id, ord, sum(greatest(1, length(content) // 3)) OVER (PARTITION BY request_id ORDER BY ord) AS used FROM ev)
SELECT request_id, max(ord) AS last_kept, max(used)::BIGINT AS tokens FROM run WHERE used <= 400 - request_id % 50 GROUP BY 1""")
def hard_limit_trim(spark, sf):
    rows = line_evidence(spark, sf).withColumn("base", F.col("request_id") % 50)
    kept = packing.trim_to_limit(rows, F.col("base"), 400)
    return kept.groupBy("request_id").agg(
        F.max("ord").alias("last_kept"), F.sum(tx.estimate_tokens(F.col("content"))).alias("tokens")
    )


@query("result_compaction", f"""WITH {SQL_EVIDENCE},
enc AS (SELECT request_id, ord, to_json({{path: path, start_line: start_line, content: left(content, 300)}})::VARCHAR AS j FROM ev),
run AS (SELECT *, sum(length(j)) OVER (PARTITION BY request_id ORDER BY ord) AS used FROM enc)
SELECT request_id, ord, length(j) AS chars FROM run WHERE used <= 1500""")
def result_compaction(spark, sf):
    kept = packing.compact_results(line_evidence(spark, sf), 2000, 300)
    return kept.select("request_id", "ord", F.length("encoded").alias("chars"))


@query("overview_budget", f"""WITH {co.SQL_FILES}, b AS (SELECT file_id, content, file_id * 37 % 20000 AS m, least(4500, greatest(1200, floor((file_id * 37 % 20000) * 0.38::DOUBLE)))::BIGINT AS budget FROM files)
SELECT file_id, budget, CASE WHEN length(content) <= budget THEN content ELSE left(content, greatest(0, budget - {len(packing.OVERVIEW_SUFFIX)})) || '{packing.OVERVIEW_SUFFIX}' END AS overview FROM b""")
def overview_budget(spark, sf):
    budget = packing.overview_budget(F.col("file_id") * 37 % 20000)
    return co.files(spark, sf).withColumn("budget", budget.cast("long")).select(
        "file_id", "budget", packing.shortened(F.col("content"), F.col("budget")).alias("overview")
    )


SQL_ASKED = f"""asked AS (SELECT file_id AS request_id, {_ASK!r}[file_id % 8 + 1] || content AS question, file_id % 11 = 0 AS ambiguous FROM files)"""


def document_questions(spark, sf):
    return co.files(spark, sf).select(
        F.col("file_id").alias("request_id"), F.concat(pick(_ASK, F.col("file_id")), F.col("content")).alias("question"),
        (F.col("file_id") % 11 == 0).alias("ambiguous"),
    )


@query("coverage_status", f"""WITH {SQL_EVIDENCE}, {SQL_ASKED},
facts AS (SELECT request_id, bool_or(resolution = 'ambiguous_candidate') AS open, count(*) AS n,
    count(*) FILTER (relation IN ('caller', 'callee', 'reference')) AS rel, count(*) FILTER (relation = 'definition') AS defs,
    count(DISTINCT (path, start_line, end_line)) FILTER (symbol IS NOT NULL) AS spans FROM ev GROUP BY 1),
settled AS (SELECT DISTINCT a.request_id FROM ev a JOIN ev b USING (request_id, symbol)
   WHERE a.resolution = 'ambiguous_candidate' AND b.resolution IN ('exact', 'enclosing'))
SELECT a.request_id, CASE WHEN coalesce(open, FALSE) AND s.request_id IS NULL THEN 'unresolved'
  WHEN CASE WHEN regexp_matches(question, '(?i){intents.MULTI_HOP}') THEN coalesce(spans, 0) >= 3 AND rel >= 2
            WHEN regexp_matches(question, '(?i){intents.RELATION}') THEN rel > 0
            WHEN regexp_matches(question, '(?i){intents.IMPLEMENTATION}') THEN defs > 0 ELSE n > 0 END THEN 'sufficient' ELSE 'insufficient' END AS status
FROM asked a LEFT JOIN facts f USING (request_id) LEFT JOIN settled s USING (request_id)""")
def coverage_status(spark, sf):
    return ev.coverage_status(document_questions(spark, sf), line_evidence(spark, sf))


@query("preflight_verdict", f"""WITH {SQL_EVIDENCE}, {SQL_ASKED},
facts AS (SELECT request_id, count(*) AS n, bool_or(relation = 'definition' AND resolution IN ('exact', 'enclosing')) AS exact,
   bool_or(relation IN ('caller', 'callee', 'reference')) AS rel FROM ev GROUP BY 1),
f AS (SELECT request_id, ambiguous, coalesce(n, 0) AS n, coalesce(exact, FALSE) AS exact, coalesce(rel, FALSE) AS rel,
   regexp_matches(question, '(?i){intents.MULTI_HOP}') AS hop, regexp_matches(question, '(?i){intents.IMPLEMENTATION}') AS impl,
   regexp_matches(question, '(?i){intents.RELATION}') AS relq, regexp_matches(question, '(?i){intents.CALLER_FOCUS}') AS focus FROM asked LEFT JOIN facts USING (request_id))
SELECT request_id, NOT (ambiguous OR hop OR (impl AND NOT exact) OR (relq AND NOT rel) OR n = 0) AS sufficient,
  CASE WHEN ambiguous THEN '目标符号存在多个同名候选，必须继续消歧' WHEN hop THEN '问题要求多跳关系，确定性预取仅覆盖一跳，必须继续追踪'
   WHEN impl AND NOT exact THEN '实现类问题缺少精确定义' WHEN relq AND NOT rel THEN '调用或影响问题缺少引用/调用边'
   WHEN n = 0 THEN '尚未找到可验证的源码证据' ELSE '确定性预取已覆盖问题所需证据' END AS reason,
  exact AND NOT focus AND NOT hop AND NOT ambiguous AS direct_target, hop AS multi_hop FROM f""")
def preflight_verdict(spark, sf):
    return ev.preflight_verdict(document_questions(spark, sf), line_evidence(spark, sf))


@query("ambiguous_answers", f"""WITH {SQL_EVIDENCE},
names AS (SELECT request_id, string_agg(symbol, ' / ' ORDER BY symbol) AS target FROM (SELECT DISTINCT request_id, symbol FROM ev WHERE symbol IS NOT NULL) GROUP BY 1)
SELECT request_id, coalesce(max(target), '目标符号') AS target,
  string_agg(path || ':' || start_line || '-' || end_line || ' [E' || ord || ']', '；' ORDER BY ord) AS locators
FROM ev LEFT JOIN names USING (request_id) GROUP BY request_id""")
def ambiguous_answers(spark, sf):
    return ev.ambiguous_answers(line_evidence(spark, sf).withColumn("evidence_id", F.concat(F.lit("E"), "ord")))


@query("answer_chain", f"""WITH {SQL_EVIDENCE},
q AS (SELECT *, CASE WHEN ord % 2 = 0 AND regexp_extract(content, '^[A-Za-z]+ ([A-Za-z]+)', 1) <> '' THEN symbol || '.' || regexp_extract(content, '^[A-Za-z]+ ([A-Za-z]+)', 1)
   ELSE symbol END AS qn, CASE WHEN ord % 3 = 0 THEN 'function' ELSE 'class' END AS kind FROM ev WHERE symbol IS NOT NULL),
kept AS (SELECT * FROM q a WHERE NOT (kind = 'class' AND EXISTS (SELECT 1 FROM q b WHERE b.request_id = a.request_id AND starts_with(b.qn, a.qn || '.')))),
once AS (SELECT request_id, path, start_line, end_line, qn, min(ord) AS ord FROM kept GROUP BY ALL)
SELECT request_id, string_agg(qn, ' → ' ORDER BY ord) AS chain FROM once GROUP BY 1""")
def answer_chain(spark, sf):
    second = F.regexp_extract("content", "^[A-Za-z]+ ([A-Za-z]+)", 1)
    rows = line_evidence(spark, sf).filter("symbol IS NOT NULL").withColumn(
        "qualified_name",
        F.when((F.col("ord") % 2 == 0) & (second != ""), F.concat("symbol", F.lit("."), second)).otherwise(F.col("symbol")),
    ).withColumn("kind", F.when(F.col("ord") % 3 == 0, "function").otherwise("class"))
    return ev.answer_chain(rows)


@query("segment_evidence", f"""WITH {SQL_EVIDENCE},
segs AS (SELECT file_id AS request_id, path, (line_no - 1) // 4 AS segment_id, min(line_no) AS s, max(line_no) AS e, string_agg(line, chr(10) ORDER BY line_no) AS code FROM line_rows GROUP BY ALL),
ids AS (SELECT DISTINCT request_id, segment_id, unnest(regexp_extract_all(code, '[A-Za-z_][\\p{{L}}\\p{{N}}_]*')) AS symbol FROM segs),
pairs AS (SELECT s.request_id, s.segment_id, v.ord, CASE WHEN (v.path = s.path AND v.start_line <= s.e AND v.end_line >= s.s)
     OR EXISTS (SELECT 1 FROM ids i WHERE i.request_id = s.request_id AND i.segment_id = s.segment_id AND i.symbol = v.symbol) THEN 0
     WHEN v.relation IN ('definition', 'caller', 'callee') THEN 1 END AS tier FROM segs s JOIN ev v ON v.request_id = s.request_id)
SELECT * FROM (SELECT request_id, segment_id, ord, tier, row_number() OVER (PARTITION BY request_id, segment_id ORDER BY tier, ord) AS rank
  FROM pairs WHERE tier IS NOT NULL) WHERE rank <= 18""")
def segment_evidence(spark, sf):
    segments = co.line_rows(spark, sf).groupBy(
        F.col("file_id").alias("request_id"), "path", F.floor((F.col("line_no") - 1) / 4).alias("segment_id")
    ).agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"),
        ev.joined(F.col("line"), F.col("line_no"), "\n").alias("code"),
    )
    return ev.evidence_for_segments(segments, line_evidence(spark, sf)).select(
        "request_id", "segment_id", "ord", "tier", "rank"
    )


@query("evidence_merge", f"""WITH {SQL_EVIDENCE},
known AS (SELECT DISTINCT request_id, path, start_line, source_hash FROM ev WHERE ord % 3 <> 0),
found AS (SELECT DISTINCT request_id, path, start_line, source_hash FROM ev WHERE ord % 2 = 0)
SELECT f.request_id, count(*) FILTER (k.request_id IS NULL) AS new_rows, count(*) FILTER (k.request_id IS NULL) = 0 AS no_progress
FROM found f LEFT JOIN known k ON k.request_id = f.request_id AND k.path = f.path AND k.start_line = f.start_line AND k.source_hash = f.source_hash GROUP BY 1""")
def evidence_merge(spark, sf):
    rows = line_evidence(spark, sf)
    return ev.merge_new(rows.filter("ord % 3 <> 0"), rows.filter("ord % 2 = 0"))


# --- orders as requests: a request's call sites are its line numbers ---------------------------


def site_evidence(spark, sf):
    n = F.col("l_linenumber")
    return sites(spark, sf).select(
        F.col("l_orderkey").alias("request_id"), n.alias("ord"), F.concat(F.lit("p"), F.col("part") % 50).alias("path"),
        n.alias("start_line"), (n + F.col("supp") % 3).alias("end_line"), pick(list(fusion.RELATIONS), n).alias("relation"),
        F.col("part").alias("symbol_id"), F.concat(F.lit("s"), F.col("part") % 4).alias("symbol"),
        F.concat(F.lit("s"), F.col("supp") % 4).alias("graph_origin"),
        F.when(F.col("supp") % 2 == 0, "resolved").otherwise("ambiguous").alias("resolution_status"),
        pick(["exact", "enclosing", "none"], F.col("part")).alias("resolution"),
    )


SQL_SITE_EVIDENCE = f"""{SQL_SITES},
sev AS (SELECT l_orderkey AS request_id, l_linenumber AS ord, 'p' || part % 50 AS path, l_linenumber AS start_line, l_linenumber + supp % 3 AS end_line,
  {list(fusion.RELATIONS)!r}[l_linenumber % 5 + 1] AS relation, part AS symbol_id, 's' || part % 4 AS symbol, 's' || supp % 4 AS graph_origin,
  CASE WHEN supp % 2 = 0 THEN 'resolved' ELSE 'ambiguous' END AS resolution_status, ['exact','enclosing','none'][part % 3 + 1] AS resolution FROM sites)"""


@query("scope_restriction", f"""WITH {SQL_SITE_EVIDENCE},
paths AS (SELECT DISTINCT request_id, path FROM sev WHERE ord <= 2),
many AS (SELECT request_id FROM paths GROUP BY 1 HAVING count(*) > 1)
SELECT request_id, ord FROM sev s WHERE request_id NOT IN (SELECT request_id FROM many)
  OR EXISTS (SELECT 1 FROM paths p WHERE p.request_id = s.request_id AND p.path = s.path) OR relation IN ('caller', 'callee')
  OR (relation = 'reference' AND resolution_status = 'resolved')""")
def scope_restriction(spark, sf):
    rows = site_evidence(spark, sf)
    return ev.restrict_scope(rows, rows.filter("ord <= 2")).select("request_id", "ord")


@query("target_focus", f"""WITH {SQL_SITE_EVIDENCE},
targets AS (SELECT DISTINCT request_id, symbol_id FROM sev WHERE ord = 1 AND symbol_id % 3 > 0),
names AS (SELECT DISTINCT request_id, symbol FROM sev JOIN targets USING (request_id, symbol_id)),
rated AS (SELECT s.*, t.symbol_id IS NOT NULL OR (s.relation = 'callee' AND n.symbol IS NOT NULL) AS f FROM sev s
  LEFT JOIN targets t ON t.request_id = s.request_id AND t.symbol_id = s.symbol_id
  LEFT JOIN names n ON n.request_id = s.request_id AND n.symbol = s.graph_origin)
SELECT request_id, ord FROM (SELECT *, bool_or(f) OVER (PARTITION BY request_id) AS anyf FROM rated) WHERE f OR NOT anyf""")
def target_focus(spark, sf):
    rows = site_evidence(spark, sf)
    return ev.focus_on_targets(rows, rows.filter("ord = 1 AND symbol_id % 3 > 0")).select("request_id", "ord")


@query("target_lines", f"""WITH {SQL_SITE_EVIDENCE},
targets AS (SELECT DISTINCT request_id, symbol_id FROM sev WHERE ord = 1 AND symbol_id % 3 > 0),
lines AS (SELECT request_id, '- ' || path || ':' || start_line || '-' || end_line || ' (' || symbol || ')' AS entry,
   t.symbol_id IS NOT NULL AND resolution IN ('exact', 'enclosing') AS exact, resolution = 'enclosing' AS around
  FROM sev LEFT JOIN targets t USING (request_id, symbol_id)),
best AS (SELECT request_id, bool_or(exact) AS anyx FROM lines GROUP BY 1)
SELECT request_id, string_agg(entry, chr(10) ORDER BY entry) AS target_note FROM (
  SELECT DISTINCT request_id, entry FROM lines JOIN best USING (request_id) WHERE exact OR (NOT anyx AND around)) GROUP BY 1""")
def target_lines(spark, sf):
    rows = site_evidence(spark, sf)
    return ev.target_lines(rows, rows.filter("ord = 1 AND symbol_id % 3 > 0"))


@query("last_definition_wins", f"""WITH {SQL_SITE_EVIDENCE}
SELECT path, relation, arg_max(symbol_id, request_id * 8 + ord) AS symbol_id, min(request_id * 8 + ord) AS slot FROM sev GROUP BY ALL""")
def last_definition_wins(spark, sf):
    rows = site_evidence(spark, sf).select("path", "relation", "symbol_id", (F.col("request_id") * 8 + F.col("ord")).alias("place"))
    return packing.last_wins(rows, ["path", "relation"], "place").select("path", "relation", "symbol_id", "slot")


@query("rank_fusion", """WITH per AS (SELECT l_returnflag AS request_id, l_suppkey, sum(l_quantity) AS q, count(*) AS c, max(l_partkey) AS m FROM lineitem GROUP BY ALL),
lists AS (SELECT request_id, 0 AS list_no, 'quantity' AS list_name, l_suppkey, row_number() OVER (PARTITION BY request_id ORDER BY q DESC, l_suppkey) AS position FROM per
  UNION ALL SELECT request_id, 1, 'count', l_suppkey, row_number() OVER (PARTITION BY request_id ORDER BY c DESC, l_suppkey) FROM per
  UNION ALL SELECT request_id, 2, 'part', l_suppkey, row_number() OVER (PARTITION BY request_id ORDER BY m DESC, l_suppkey) FROM per)
SELECT request_id, l_suppkey, round(sum(1.0::DOUBLE / (60.0::DOUBLE + position)), 9) AS rrf_score, string_agg(list_name, ',' ORDER BY list_no) AS sources,
  arg_min(position, list_no) AS first_position FROM lists WHERE position <= 30 GROUP BY ALL""")
def rank_fusion(spark, sf):
    per = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("request_id"), "l_suppkey").agg(
        F.sum("l_quantity").alias("quantity"), F.count("*").alias("count"), F.max("l_partkey").alias("part")
    )
    lists = None
    for number, name in enumerate(("quantity", "count", "part")):
        ranked = top_k(per, ["request_id"], [F.col(name).desc(), F.col("l_suppkey")], 30, "position").select(
            "request_id", "l_suppkey", F.lit(number).alias("list_no"), F.lit(name).alias("list_name"), "position",
            F.col("position").alias("first_position"),
        )
        lists = ranked if lists is None else lists.unionByName(ranked)
    return fusion.reciprocal_rank_fusion(lists, ["l_suppkey"]).select(
        "request_id", "l_suppkey", F.round("rrf_score", 9).alias("rrf_score"), "sources", "first_position"
    )


@query("work_list", f"""WITH {SQL_SNAPSHOTS},
seg AS (SELECT file_id, path, sha256('segment|v1|' || CASE WHEN file_id % 3 = 0 THEN 'detailed' ELSE 'simple' END || '|' || path || '|' || source_hash) AS key FROM now),
cache AS (SELECT sha256('segment|v1|' || m || '|' || path || '|' || source_hash) AS key FROM stored, (VALUES ('simple'), ('detailed')) t(m)),
forced AS (SELECT doc_id FROM labels WHERE quality = 0)
SELECT file_id, path, key FROM seg WHERE key NOT IN (SELECT key FROM cache) OR file_id IN (SELECT doc_id FROM forced)""")
def work_list(spark, sf):
    from codequarry.operators import cache

    files, stored = snapshot_pair(spark, sf)
    mode = F.when(F.col("file_id") % 3 == 0, "detailed").otherwise("simple")
    items = files.select(
        "file_id", "path", cache.make_key(F.lit("segment"), F.lit("v1"), mode, F.col("path"), F.col("source_hash")).alias("key")
    )
    modes = F.explode(F.array(F.lit("simple"), F.lit("detailed")))
    kept = stored.select("path", "source_hash", modes.alias("mode")).select(
        cache.make_key(F.lit("segment"), F.lit("v1"), F.col("mode"), F.col("path"), F.col("source_hash")).alias("key")
    )
    forced = load(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("file_id"))
    return cache.work_list(items, kept, forced, "file_id")


@query("retrieval_quality", f"""WITH {co.SQL_OUTLINE},
truth AS (SELECT symbol_id, project_id, path, language, name FROM symbols),
found AS (SELECT t.symbol_id AS request_id, s.symbol_id, s.path, row_number() OVER (PARTITION BY t.symbol_id ORDER BY (s.path <> t.path)::INT, s.symbol_id) AS rank
  FROM truth t JOIN symbols s ON lower(s.name) = lower(t.name) AND s.project_id = t.project_id),
judged AS (SELECT t.language, f.symbol_id IS NOT DISTINCT FROM t.symbol_id AS hit, f.path IS DISTINCT FROM t.path AS false_exact FROM truth t LEFT JOIN found f ON f.request_id = t.symbol_id AND rank = 1)
SELECT language, count(*) AS questions, round(avg(hit::INT), 6) AS recall_at_1, count(*) FILTER (false_exact) AS false_exact FROM judged GROUP BY 1""")
def retrieval_quality(spark, sf):
    from codequarry.operators import lookup, metrics

    symbols = co.outline_symbols(spark, sf)
    truth = symbols.select(
        F.col("symbol_id").alias("request_id"), "project_id", F.col("path").alias("current_file"), "language", "name"
    )
    top = lookup.definitions(truth.drop("language"), symbols, 1, ["request_id"]).select("request_id", "symbol_id", "path")
    return metrics.retrieval_gate(truth, top, ["language"])
