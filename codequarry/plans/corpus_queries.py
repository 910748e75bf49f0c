"""Registered queries over documents as files: scanning rules, listings, spans, change detection."""

from __future__ import annotations

import builtins
import keyword

from pyspark.sql import functions as F

from codequarry.functions import intents
from codequarry.functions import paths as px
from codequarry.functions import text as tx
from codequarry.operators import chunks as ck
from codequarry.operators import files as fx
from codequarry.operators import refresh
from codequarry.options import Options
from codequarry.plans import corpora as co
from codequarry.plans.registry import query
from codequarry.sources.tables import load

_SMALL_CAP = Options(max_file_bytes=4000)


@query("size_skip_list", f"""WITH {co.SQL_FILES}
SELECT project_id, path, size, size > 4000 AS skipped FROM files""")
def size_skip_list(spark, sf):
    return co.files(spark, sf).select(
        "project_id", "path", "size", (F.col("size") > _SMALL_CAP.max_file_bytes).alias("skipped")
    )


IGNORE_FILE = ["# generated", "", "*_1?.txt", "/src3/de/", "fr/", "!doc_1*.txt", "/src1*/en/doc_*2.txt",
               "en/doc_*7.txt", r"\!odd", "es"]


@query("ignore_rules", f"""WITH {co.SQL_FILES}
SELECT project_id, path, CASE
  WHEN list_contains(string_split(path, '/'), 'es') THEN TRUE
  WHEN regexp_matches(path, '^(.*/)?en/doc_.*7\\.txt$') THEN TRUE
  WHEN regexp_matches(path, '^src1.*/en/doc_.*2\\.txt$') THEN TRUE
  WHEN regexp_matches(path, '(^|/)doc_1[^/]*\\.txt$') THEN FALSE
  WHEN path LIKE 'fr/%' OR path LIKE '%/fr/%' THEN TRUE
  WHEN path LIKE 'src3/de/%' THEN TRUE
  WHEN regexp_matches(path, '(^|/)[^/]*_1[^/]\\.txt$') THEN TRUE
  ELSE FALSE END AS ignored FROM files""")
def ignore_rules(spark, sf):
    parsed = F.array(*[px.parse_ignore_rule(F.lit(line)) for line in IGNORE_FILE])
    rules = F.filter(parsed, lambda rule: rule.isNotNull())
    return co.files(spark, sf).select("project_id", "path", px.is_ignored(F.col("path"), rules).alias("ignored"))


_EXTS = ["py", "TSX", "h", "rs", "jsonc", "xyz", "lock", "Yml", "r", "gql", "hpp"]


def _named_parts(spark, sf):
    parts = load(spark, sf, "part")
    stem = F.concat_ws("/", "p_brand", F.replace("p_name", F.lit(" "), F.lit("_")))
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("p_size") % len(_EXTS)).cast("int") + 1)
    return parts.select(
        "p_partkey",
        F.when(F.col("p_type") == "PROMO", F.concat(F.col("p_brand"), F.lit("/README."), F.col("p_size")))
        .when(F.col("p_type") == "LARGE", F.concat(F.col("p_brand"), F.lit("/Dockerfile")))
        .when(F.col("p_type") == "SMALL", F.concat(F.col("p_brand"), F.lit("/."), ext))
        .otherwise(F.concat(stem, F.lit("."), ext)).alias("path"),
    )


@query("language_classify", """WITH named AS (
  SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_brand || '/README.' || p_size
    WHEN p_type = 'LARGE' THEN p_brand || '/Dockerfile'
    WHEN p_type = 'SMALL' THEN p_brand || '/.' || ext
    ELSE p_brand || '/' || replace(p_name, ' ', '_') || '.' || ext END AS path
  FROM (SELECT *, ['py','TSX','h','rs','jsonc','xyz','lock','Yml','r','gql','hpp'][p_size % 11 + 1] AS ext FROM part)),
known(e, lang) AS (VALUES ('py','python'), ('tsx','typescript'), ('h','c'), ('rs','rust'), ('jsonc','json'),
  ('lock','plaintext'), ('yml','yaml'), ('r','r'), ('gql','graphql'), ('hpp','cpp'))
SELECT p_partkey, path, coalesce(lang, CASE WHEN path LIKE '%/README.%' OR path LIKE '%/Dockerfile' THEN 'plaintext'
  ELSE 'none' END) AS language
FROM named LEFT JOIN known ON e = lower(regexp_extract(path, '/[^/]+\\.([^./]+)$', 1))""")
def language_classify(spark, sf):
    return _named_parts(spark, sf).select(
        "p_partkey", "path", F.coalesce(px.language(F.col("path")), F.lit("none")).alias("language")
    )


@query("file_facts", f"""WITH {co.SQL_LINED}
SELECT project_id, path, source_hash, line_count,
       replace(project_id || '/' || language || '/doc_' || file_id, '/', '.') AS module_name FROM lined""")
def file_facts(spark, sf):
    return co.file_lines(spark, sf).select(
        "project_id", "path", "source_hash", "line_count",
        px.module_name(F.regexp_replace("path", r"\.txt$", ".py")).alias("module_name"),
    )


@query("file_listing", f"""WITH {co.SQL_FILES}
SELECT project_id, path FROM files WHERE path GLOB 'src[1-4]/*doc_*[!3]?.txt'""")
def file_listing(spark, sf):
    return fx.list_files(co.files(spark, sf), F.lit("src[1-4]/*doc_*[!3]?.txt")).select("project_id", "path")


@query("directory_children", f"""WITH {co.SQL_FILES}, parts AS (SELECT project_id, string_split(path, '/') AS p FROM files),
levels AS (SELECT project_id, p, unnest(range(0, len(p))) AS d FROM parts)
SELECT project_id, array_to_string(p[1:d], '/') AS prefix, p[d + 1] AS name, bool_or(d < len(p) - 1) AS is_dir,
       NOT bool_or(d < len(p) - 1) AND ends_with(p[d + 1], '.txt') AS is_code FROM levels
GROUP BY ALL""".replace("SELECT project_id, array_to_string", "SELECT DISTINCT project_id, array_to_string").replace(
    "bool_or(d < len(p) - 1)", "(d < len(p) - 1)").replace("\nGROUP BY ALL", ""))
def directory_children(spark, sf):
    return fx.directory_children(co.files(spark, sf))


def _label_spans(spark, sf):
    return load(spark, sf, "labels").select(
        F.col("doc_id").alias("file_id"),
        (F.col("doc_id") % 9 - F.lit(1)).cast("int").alias("start"),
        (F.col("doc_id") % 9 + F.col("doc_id") % 13 * 20 - F.col("quality")).cast("int").alias("end"),
    )


@query("read_span", f"""WITH {co.SQL_LINED},
asked AS (SELECT doc_id, doc_id % 9 - 1 AS s, doc_id % 9 + doc_id % 13 * 20 - quality AS e FROM labels),
judged AS (SELECT *, CASE WHEN lines IS NULL THEN 'missing_file'
    WHEN s < 1 OR e < s OR e - s + 1 > 200 THEN 'invalid_span'
    WHEN size > 2000000 THEN 'file_too_large' WHEN e > line_count THEN 'past_end'
    WHEN strlen(array_to_string(lines[s:e], chr(10))) > 65536 THEN 'span_too_large' END AS error
  FROM asked LEFT JOIN lined ON file_id = doc_id)
SELECT doc_id AS request_id, s AS start_line, e AS end_line, coalesce(error, '') AS error,
       CASE WHEN error IS NULL THEN array_to_string(lines[s:e], chr(10)) END AS content FROM judged""")
def read_span(spark, sf):
    asked = _label_spans(spark, sf).join(co.file_lines(spark, sf), "file_id", "left")
    span = fx.read_span(F.col("lines"), F.col("size"), F.col("start"), F.col("end"))
    return asked.select(
        F.col("file_id").alias("request_id"), F.col("start").alias("start_line"), F.col("end").alias("end_line"),
        F.coalesce(span["error"], F.lit("")).alias("error"), span["content"].alias("content"),
    )


@query("path_containment", """WITH raw AS (
  SELECT page_id, CASE page_id % 7 WHEN 0 THEN p WHEN 1 THEN '/' || p WHEN 2 THEN 'C:\\' || p WHEN 3 THEN '..\\' || p
     WHEN 4 THEN replace(p, '/', '\\') WHEN 5 THEN replace(p, '/', '/./') ELSE replace(p, '/', '//') END AS raw
  FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)),
split AS (SELECT *, string_split(replace(raw, '\\', '/'), '/') AS parts FROM raw)
SELECT page_id, raw, CASE WHEN raw = '' THEN 'empty' WHEN raw LIKE '/%' THEN 'absolute'
   WHEN regexp_matches(raw, '^[A-Za-z]:') THEN 'drive' WHEN list_contains(parts, '..') THEN 'parent'
   WHEN list_contains(parts, '.') THEN 'not_canonical' ELSE '' END AS problem,
   array_to_string(list_filter(parts, lambda x: x NOT IN ('', '.')), '/') AS normalized FROM split""")
def path_containment(spark, sf):
    p = F.regexp_replace("url", "^https?://", "")
    kind = F.col("page_id") % 7
    raw = (
        F.when(kind == 0, p).when(kind == 1, F.concat(F.lit("/"), p)).when(kind == 2, F.concat(F.lit("C:\\"), p))
        .when(kind == 3, F.concat(F.lit("..\\"), p)).when(kind == 4, F.replace(p, F.lit("/"), F.lit("\\")))
        .when(kind == 5, F.replace(p, F.lit("/"), F.lit("/./"))).otherwise(F.replace(p, F.lit("/"), F.lit("//")))
    )
    return load(spark, sf, "pages").select("page_id", raw.alias("raw")).select(
        "page_id", "raw", F.coalesce(px.path_problem(F.col("raw")), F.lit("")).alias("problem"),
        px.normalized(F.col("raw")).alias("normalized"),
    )


COMMON_NAMES = sorted(
    set(keyword.kwlist) | set(dir(builtins))
    | set("self cls args kwargs np pd plt os sys re json time math logging typing pathlib".split())
)
_SQL_COMMON = ", ".join("'" + n + "'" for n in COMMON_NAMES)
_SQL_STOP = ", ".join("'" + n + "'" for n in tx.STOP_IDENTIFIERS)


def _sql_ordered(source: str, take: int | None) -> str:
    """SQL: distinct list elements in first-seen order, joined by a blank."""
    cut = f"[:{take}]" if take else ""
    seen = f"list_filter({source}, lambda w, i: list_position({source}, w) = i)"
    return f"array_to_string(({seen}){cut}, ' ')"


_ID = "regexp_extract_all(text, '[A-Za-z_][\\p{L}\\p{N}_]*')"


@query("query_terms", f"""WITH said AS (SELECT 'c' || conv_id || '.' || turn AS request_id, text FROM conversations
  UNION ALL SELECT 'b' || item_id, text FROM benchmark),
named AS (SELECT *, {_ID} AS ids, regexp_extract_all(text, '[\\x{{3400}}-\\x{{9fff}}]{{2,}}') AS cjk,
   regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS ascii_ids FROM said),
prep AS (SELECT *, list_concat(ids, cjk) AS lits,
   list_filter(ids, lambda w: lower(w) NOT IN ({_SQL_STOP})) AS asked,
   list_filter(ascii_ids, lambda w: length(w) >= 2 AND w NOT IN ({_SQL_COMMON})) AS code FROM named)
SELECT request_id, array_to_string(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:_[\\p{{L}}\\p{{N}}]+)*')[:20], ' ') AS fts,
   {_sql_ordered('lits', 8)} AS literals, {_sql_ordered('ids', 12)} AS candidates,
   {_sql_ordered('asked', 16)} AS identifiers, {_sql_ordered('code', None)} AS code_names FROM prep""")
def query_terms(spark, sf):
    said = load(spark, sf, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("request_id"), "text"
    ).unionByName(load(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("request_id"), "text"))
    text = F.col("text")
    return said.select(
        "request_id", tx.listed(tx.fts_terms(text), " ").alias("fts"),
        tx.listed(tx.literal_terms(text), " ").alias("literals"),
        tx.listed(tx.symbol_candidates(text), " ").alias("candidates"),
        tx.listed(tx.question_identifiers(text), " ").alias("identifiers"),
        tx.listed(tx.code_identifiers(text, COMMON_NAMES), " ").alias("code_names"),
    )


_ASK = ["who calls it: ", "How is this implemented? ", "两跳调用链 ", "depth  3 of ", "哪里调用 ", "what is the source of ", "", "impact of "]


@query("question_intents", f"""WITH asked AS (SELECT conv_id, turn, {_ASK!r}[(conv_id + turn) % 8 + 1] || text AS q FROM conversations)
SELECT conv_id, turn, regexp_matches(q, '(?i){intents.IMPLEMENTATION}') AS implementation,
  regexp_matches(q, '(?i){intents.RELATION}') AS relation, regexp_matches(q, '(?i){intents.MULTI_HOP}') AS multi_hop,
  regexp_matches(q, '(?i){intents.CALLER_FOCUS}') AS caller_focus FROM asked""")
def question_intents(spark, sf):
    lead = F.element_at(F.array(*[F.lit(a) for a in _ASK]), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    return load(spark, sf, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("q")).select(
        "conv_id", "turn", *intents.flags(F.col("q"))
    )


@query("argument_guards", """WITH asked AS (SELECT conv_id, turn, CASE WHEN turn = 3 THEN '   ' ELSE text END AS v,
   CASE turn WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '17' WHEN 3 THEN '-4' WHEN 4 THEN '100001' WHEN 5 THEN 'x1'
        ELSE (conv_id * 1000)::VARCHAR END AS c FROM conversations)
SELECT conv_id, turn, coalesce(CASE WHEN trim(v) = '' THEN 'required' WHEN length(trim(v)) > 500 THEN 'too_long' END, '') AS argument,
  CASE WHEN c IS NULL OR c = '' THEN '' WHEN TRY_CAST(c AS BIGINT) IS NULL OR TRY_CAST(c AS BIGINT) NOT BETWEEN 0 AND 100000
       THEN 'invalid_cursor' ELSE '' END AS cursor_check FROM asked""")
def argument_guards(spark, sf):
    turn = F.col("turn")
    cursor = (
        F.when(turn == 0, F.lit(None)).when(turn == 1, F.lit("")).when(turn == 2, F.lit("17"))
        .when(turn == 3, F.lit("-4")).when(turn == 4, F.lit("100001")).when(turn == 5, F.lit("x1"))
        .otherwise((F.col("conv_id") * 1000).cast("string"))
    )
    asked = load(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(turn == 3, F.lit("   ")).otherwise(F.col("text")).alias("v"), cursor.alias("c")
    )
    return asked.select(
        "conv_id", "turn", F.coalesce(fx.argument_problem(F.col("v"), True), F.lit("")).alias("argument"),
        F.coalesce(fx.cursor_problem(F.col("c")), F.lit("")).alias("cursor_check"),
    )


@query("identifier_at_cursor", f"""WITH {co.SQL_LINE_ROWS}, spots AS (SELECT file_id, line_no, line,
   least(greatest((file_id + line_no) % 60 - 1, 0), length(line)) AS spot FROM line_rows),
words AS (SELECT *, regexp_extract(left(line, spot), '[A-Za-z0-9_]*$') || regexp_extract(substr(line, spot + 1), '^[A-Za-z0-9_]*') AS w FROM spots)
SELECT file_id, line_no, CASE WHEN w <> '' AND NOT regexp_matches(w, '^[0-9]') THEN w ELSE '' END AS symbol FROM words""")
def identifier_at_cursor(spark, sf):
    column = ((F.col("file_id") + F.col("line_no")) % 60).cast("int")
    return co.line_rows(spark, sf).select(
        "file_id", "line_no", F.coalesce(tx.identifier_at(F.col("line"), column), F.lit("")).alias("symbol")
    )


@query("preview_and_selection", f"""WITH {co.SQL_LINED}, asked AS (SELECT doc_id, greatest(1, doc_id % 9 - 1) AS s,
   doc_id % 9 + doc_id % 13 * 20 - quality AS e FROM labels),
sel AS (SELECT *, least(line_count, e) AS last FROM asked JOIN lined ON file_id = doc_id)
SELECT doc_id AS request_id, path, least(80, line_count) AS preview_end,
  sha256(array_to_string(lines[1:80], chr(10))) AS preview_hash,
  CASE WHEN last >= s THEN s END AS selection_start, CASE WHEN last >= s THEN least(last, s + 399) END AS selection_end,
  CASE WHEN last >= s THEN array_to_string(lines[s:least(last, s + 399)], chr(10)) END AS selection FROM sel""")
def preview_and_selection(spark, sf):
    asked = _label_spans(spark, sf).join(co.file_lines(spark, sf), "file_id")
    chosen = asked.withColumn("sel", fx.clamp_selection(F.col("start"), F.col("end"), F.col("line_count")))
    preview = tx.join_lines(F.slice("lines", 1, Options().preview_lines))
    return chosen.select(
        F.col("file_id").alias("request_id"), "path", F.least(F.lit(80), "line_count").alias("preview_end"),
        F.sha2(preview, 256).alias("preview_hash"), F.col("sel.start_line").alias("selection_start"),
        F.col("sel.end_line").alias("selection_end"),
        tx.span_of(F.col("lines"), F.col("sel.start_line"), F.col("sel.end_line")).alias("selection"),
    )


@query("file_path_search", f"""WITH {co.SQL_LINED},
asked AS (SELECT n_nationkey AS request_id, 'src' || n_nationkey % 20 AS project_id, lower(CASE n_regionkey % 3 WHEN 0 THEN 'SRC' || n_nationkey % 20 || '/'
    WHEN 1 THEN 'oc_' || n_nationkey % 10 ELSE 'n/D' END) AS needle FROM nation),
hits AS (SELECT request_id, path, source_hash, line_count, lines, row_number() OVER (PARTITION BY request_id
    ORDER BY (NOT starts_with(lower(path), needle))::INT, length(path), lower(path), path) AS rank
  FROM asked a JOIN lined l ON l.project_id = a.project_id AND contains(lower(path), needle))
SELECT request_id, rank, path, source_hash, least(line_count, 40) AS end_line,
  sha256(array_to_string(lines[1:40], chr(10))) AS content_hash, round(0.7::DOUBLE - rank * 0.001::DOUBLE, 6) AS score
FROM hits WHERE rank <= 20 AND line_count > 0""")
def file_path_search(spark, sf):
    key = F.col("n_nationkey")
    needle = (
        F.when(F.col("n_regionkey") % 3 == 0, F.concat(F.lit("SRC"), key % 20, F.lit("/")))
        .when(F.col("n_regionkey") % 3 == 1, F.concat(F.lit("oc_"), key % 10)).otherwise(F.lit("n/D"))
    )
    asked = load(spark, sf, "nation").select(key.alias("request_id"), F.concat(F.lit("src"), key % 20).alias("project_id"), needle.alias("needle"))
    return fx.search_paths(asked, co.file_lines(spark, sf), 20).select(
        "request_id", "rank", "path", "source_hash", "end_line", F.sha2("content", 256).alias("content_hash"),
        F.round("score", 6).alias("score"),
    )


@query("project_fingerprint", f"""WITH {co.SQL_FILES},
parts AS (SELECT project_id, ('0x' || left(sha256(path), 8))::BIGINT % 1024 AS bucket, count(*) AS n,
    sha256(string_agg(path || ':' || source_hash, '|' ORDER BY path, source_hash)) AS part FROM files GROUP BY ALL)
SELECT project_id, sum(n)::BIGINT AS files, sha256(string_agg(part, '|' ORDER BY bucket)) AS fingerprint FROM parts GROUP BY ALL""")
def project_fingerprint(spark, sf):
    return fx.project_fingerprint(co.files(spark, sf))


# --- change detection -------------------------------------------------------------------------


def snapshot_pair(spark, sf):
    """Current listing, and an older stored copy: some files missing, edited or only touched."""
    kind = F.col("file_id") % 10
    files = co.files(spark, sf).withColumn("mtime_ns", F.col("file_id") * 1000)
    edited = F.when(kind == 1, F.concat("content", F.lit("x"))).when(kind == 3, F.reverse("content")).otherwise(F.col("content"))
    stored = files.filter(kind != 0).select(
        "project_id", F.when(kind == 4, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"),
        F.octet_length(edited).cast("long").alias("size"),
        F.when(kind.isin(2, 3), F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"),
        F.sha2(edited, 256).alias("source_hash"), edited.alias("content"),
    )
    return files, stored


SQL_SNAPSHOTS = f"""{co.SQL_FILES},
now AS (SELECT *, file_id * 1000 AS mtime_ns FROM files),
stored AS (SELECT project_id, CASE WHEN k = 4 THEN path || '.old' ELSE path END AS path, strlen(edited) AS size,
    CASE WHEN k IN (2, 3) THEN mtime_ns - 1 ELSE mtime_ns END AS mtime_ns, sha256(edited) AS source_hash
  FROM (SELECT *, file_id % 10 AS k, CASE file_id % 10 WHEN 1 THEN content || 'x' WHEN 3 THEN reverse(content) ELSE content END AS edited
        FROM now) WHERE k <> 0)"""


def sql_actions(stored: str) -> str:
    return f"""actions AS (SELECT project_id, path, n.language, CASE WHEN n.content IS NULL THEN 'removed'
    WHEN n.size > 2000000 THEN CASE WHEN o.source_hash IS NULL THEN 'skipped' ELSE 'removed' END
    WHEN n.size = o.size AND n.mtime_ns = o.mtime_ns THEN 'reused'
    WHEN n.source_hash = o.source_hash THEN 'confirmed' WHEN o.source_hash IS NOT NULL THEN 'updated' ELSE 'added' END AS action
  FROM now n FULL OUTER JOIN {stored} o USING (project_id, path))"""


@query("incremental_refresh", f"WITH {SQL_SNAPSHOTS}, {sql_actions('stored')} SELECT project_id, path, action FROM actions")
def incremental_refresh(spark, sf):
    files, stored = snapshot_pair(spark, sf)
    return refresh.plan_refresh(files, stored, F.sha2("content", 256)).select("project_id", "path", "action")


@query("forced_refresh", f"""WITH {SQL_SNAPSHOTS},
forced AS (SELECT project_id, path, size, CASE WHEN path IN (SELECT path FROM files JOIN labels ON doc_id = file_id WHERE quality = 0)
    THEN -1 ELSE mtime_ns END AS mtime_ns, source_hash FROM stored), {sql_actions('forced')}
SELECT project_id, path, action FROM actions""")
def forced_refresh(spark, sf):
    files, stored = snapshot_pair(spark, sf)
    poor = load(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("file_id"))
    forced = refresh.force_rehash(stored, files.join(poor, "file_id", "left_semi"))
    return refresh.plan_refresh(files, forced, F.sha2("content", 256)).select("project_id", "path", "action")


@query("removed_files", f"""WITH {SQL_SNAPSHOTS} SELECT project_id, path FROM stored
WHERE NOT EXISTS (SELECT 1 FROM now WHERE now.project_id = stored.project_id AND now.path = stored.path)""")
def removed_files(spark, sf):
    files, stored = snapshot_pair(spark, sf)
    return refresh.removed_files(stored, files).select("project_id", "path")


@query("index_status", f"""WITH {SQL_SNAPSHOTS}, {sql_actions('stored')},
langs AS (SELECT project_id, string_agg(language || '=' || n, ',' ORDER BY language) AS languages, sum(n)::BIGINT AS indexed_files
  FROM (SELECT project_id, language, count(*) AS n FROM actions WHERE action NOT IN ('removed', 'skipped') GROUP BY ALL) GROUP BY 1)
SELECT project_id, languages, indexed_files, count(*) FILTER (action = 'added') AS added_files,
  count(*) FILTER (action = 'updated') AS updated_files, count(*) FILTER (action = 'reused') AS reused_files,
  count(*) FILTER (action = 'confirmed') AS confirmed_files, count(*) FILTER (action = 'removed') AS removed_files,
  count(*) FILTER (action = 'skipped') AS skipped_files,
  (count(*) FILTER (action IN ('added', 'updated', 'removed')) > 0)::INT AS generation_step
FROM actions JOIN langs USING (project_id) GROUP BY ALL""")
def index_status(spark, sf):
    files, stored = snapshot_pair(spark, sf)
    actions = refresh.plan_refresh(files, stored, F.sha2("content", 256))
    per_language = actions.filter(~F.col("action").isin("removed", "skipped")).groupBy("project_id", "language").agg(
        F.count("*").alias("n")
    )
    pairs = F.array_sort(F.collect_list(F.concat("language", F.lit("="), F.col("n").cast("string"))))
    languages = per_language.groupBy("project_id").agg(
        F.array_join(pairs, ",").alias("languages"), F.sum("n").alias("indexed_files")
    )
    return refresh.refresh_summary(actions).join(languages, "project_id")


# --- segments ---------------------------------------------------------------------------------


@query("generic_segments", f"""WITH RECURSIVE {co.SQL_LINE_ROWS},
flags AS (SELECT file_id, line_no, regexp_full_match(line, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}]*') AS blank FROM line_rows),
walk AS (SELECT file_id, 1 AS line_no, 1 AS run, FALSE AS closed, 1 AS start_line FROM flags WHERE line_no = 1
  UNION ALL
  SELECT f.file_id, f.line_no, CASE WHEN w.cut THEN 1 ELSE w.run + 1 END, FALSE,
         CASE WHEN w.cut THEN f.line_no ELSE w.start_line END
  FROM (SELECT walk.*, (walk.run >= 50 AND p.blank) OR walk.run >= 90 AS cut FROM walk JOIN flags p USING (file_id, line_no)) w
  JOIN flags f ON f.file_id = w.file_id AND f.line_no = w.line_no + 1)
SELECT file_id, start_line, max(line_no) AS end_line, '第 ' || start_line || '~' || max(line_no) || ' 行' AS title
FROM walk GROUP BY file_id, start_line""")
def generic_segments(spark, sf):
    return ck.generic_segments(co.file_lines(spark, sf)).select("file_id", "start_line", "end_line", "title")


@query("segment_gap_fill", f"""WITH {co.SQL_LINE_ROWS}, heads AS (
  SELECT l.project_id, l.path, l.file_id, f.line_count, line_no AS start_line, line_no AS end_line
  FROM line_rows l JOIN lined f USING (file_id) WHERE regexp_matches(line, '^[A-Z][a-z]')),
seq AS (SELECT *, lag(end_line) OVER w AS pe, lead(end_line) OVER w AS ne, row_number() OVER w AS rn
  FROM heads WINDOW w AS (PARTITION BY file_id ORDER BY start_line))
SELECT file_id, rn - 1 AS segment_no, CASE WHEN pe IS NULL THEN 1 WHEN start_line > pe + 1 THEN pe + 1 ELSE start_line END AS start_line,
  CASE WHEN ne IS NULL THEN greatest(end_line, line_count) ELSE end_line END AS end_line FROM seq""")
def segment_gap_fill(spark, sf):
    heads = co.file_lines(spark, sf).select("file_id", "line_count", F.posexplode("lines").alias("pos", "line")).filter(
        F.col("line").rlike("^[A-Z][a-z]")
    )
    spans = heads.select(
        "file_id", "line_count", (F.col("pos") + 1).alias("start_line"), (F.col("pos") + 1).alias("end_line")
    )
    return ck.fill_gaps(spans, ["file_id"]).select("file_id", "segment_no", "start_line", "end_line")


@query("numbered_and_skeleton", f"""WITH {co.SQL_LINED}
SELECT file_id, sha256(array_to_string(list_transform(lines, lambda l, i: (i + 9)::VARCHAR || '| ' || l), chr(10))) AS numbered_hash,
  left(CASE WHEN language IN ('en', 'de') THEN array_to_string(list_concat(lines[1:40], CASE WHEN line_count > 40 THEN ['# …'] ELSE [] END), chr(10))
   ELSE array_to_string(lines[1:2], chr(10)) || chr(10) || '    # …（共 ' || line_count || ' 行，实现省略）' END, 300) AS skeleton,
  sha256(array_to_string(list_concat(list_filter(lines, lambda l: trim(l) <> '')[1:30],
     CASE WHEN len(list_filter(lines, lambda l: trim(l) <> '')) > 30 THEN ['# …（更多导入省略）'] ELSE [] END), chr(10))) AS imports_hash
FROM lined""")
def numbered_and_skeleton(spark, sf):
    kind = F.when(F.col("language").isin("en", "de"), F.lit("globals")).otherwise(F.lit("function"))
    lines = F.col("lines")
    return co.file_lines(spark, sf).select(
        "file_id", F.sha2(tx.numbered(lines, F.lit(10)), 256).alias("numbered_hash"),
        F.substring(ck.skeleton_part(kind, lines), 1, 300).alias("skeleton"),
        F.sha2(ck.imports_summary(lines), 256).alias("imports_hash"),
    )


@query("relative_imports", f"""WITH {co.SQL_FILES},
asked AS (SELECT file_id, project_id || '.' || language || '.m' || file_id AS module, file_id % 4 = 0 AS is_package,
   CASE file_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a.b' ELSE 'c' END AS imported, (file_id % 5)::INT AS level FROM files),
home AS (SELECT *, CASE WHEN is_package THEN string_split(module, '.') ELSE string_split(module, '.')[:-2] END AS h FROM asked)
SELECT file_id, CASE WHEN level = 0 THEN coalesce(imported, '')
  ELSE array_to_string(list_concat(h[1:greatest(0, len(h) - level + 1)], CASE WHEN imported IS NULL THEN [] ELSE string_split(imported, '.') END), '.') END AS absolute FROM home""")
def relative_imports(spark, sf):
    number = F.col("file_id")
    imported = F.when(number % 3 == 0, None).when(number % 3 == 1, "a.b").otherwise("c")
    module = F.concat_ws(".", "project_id", "language", F.concat(F.lit("m"), number))
    return co.files(spark, sf).select(
        "file_id", px.absolute_module(module, number % 4 == 0, imported, (number % 5).cast("int")).alias("absolute")
    )


@query("distinct_in_order", """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM w""")
def distinct_in_order(spark, sf):
    """Order-preserving distinct, as used for warnings and ids."""
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words")
    )


@query("sql_functions", f"""WITH {co.SQL_FILES}
SELECT file_id, replace(path, '/', '/') AS normal, path GLOB 'src1*/[!e]?/doc_*' AS matched FROM files""")
def sql_functions(spark, sf):
    from codequarry.functions import sql

    sql.register(spark)
    odd = F.concat(F.lit(".\\"), F.replace("path", F.lit("/"), F.lit("//")))
    return co.files(spark, sf).withColumn("odd", odd).select(
        "file_id", F.expr("norm_path(odd)").alias("normal"), F.expr("path rlike glob_to_regex('src1*/[!e]?/doc_*')").alias("matched")
    )
