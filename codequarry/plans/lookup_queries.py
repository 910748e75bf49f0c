"""Registered queries: lookups, references and traces over documents as an outline corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import edges, fusion, lookup, repo_map
from codequarry.operators import files as fx
from codequarry.options import DEFAULTS
from codequarry.plans import corpora as co
from codequarry.plans import stored
from codequarry.plans.registry import query
from codequarry.plans.search_queries import SQL_CANDIDATES, SQL_EVERY_CANDIDATE, SQL_GRAPH_HEADS
from codequarry.session import cut
from codequarry.sources.tables import load


def named_requests(spark, sf, limit=DEFAULTS.symbol_candidates):
    """The candidate names of every benchmark item, in the project of the open document."""
    return co.requests(spark, sf).select(
        "request_id", "project_id", "current_file", F.posexplode(tx.symbol_candidates(F.col("question"), limit)).alias("candidate", "name")
    )


SQL_NAMED = f"""{co.SQL_REQUESTS}, {SQL_CANDIDATES},
asked AS (SELECT n.request_id, r.project_id, n.candidate, n.name, r.current_file FROM names n JOIN requests r USING (request_id))"""
_KEYS = ["request_id", "candidate"]


@query("definition_lookup", f"""WITH {co.SQL_OUTLINE}, {SQL_NAMED},
found AS (SELECT request_id, candidate, symbol_id, path, start_line, kind, row_number() OVER (PARTITION BY request_id, candidate
   ORDER BY coalesce(path <> current_file, true)::INT, symbol_id) AS rank FROM asked a JOIN symbols s ON lower(s.name) = lower(a.name) AND s.project_id = a.project_id)
SELECT request_id, candidate, rank, symbol_id, path, start_line, kind, round(1.0::DOUBLE - least(rank - 1, 20) * 0.01::DOUBLE, 6) AS score
FROM found WHERE rank <= 20""")
def definition_lookup(spark, sf):
    found = lookup.definitions(named_requests(spark, sf), co.outline_symbols(spark, sf), 20, _KEYS)
    return found.select(
        "request_id", "candidate", "rank", "symbol_id", "path", "start_line", "kind",
        F.round(fusion.decayed(1.0, F.col("rank")), 6).alias("score"),
    )


@query("symbol_search", f"""WITH {co.SQL_OUTLINE}, {SQL_NAMED.replace(SQL_CANDIDATES, SQL_EVERY_CANDIDATE)},
needles AS (SELECT request_id || ':' || candidate || typed AS request_id, project_id, translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS needle, current_file
  FROM asked, LATERAL (VALUES ('', name), (':typed', left(name, 1 + request_id % 4))) v(typed, part)),
found AS (SELECT request_id, symbol_id, name, path, CASE WHEN lower(name) = needle THEN 0 WHEN starts_with(lower(name), needle) THEN 1 ELSE 2 END AS cls,
    row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN lower(name) = needle THEN 0 WHEN starts_with(lower(name), needle) THEN 1 ELSE 2 END,
      coalesce(path <> current_file, true)::INT, length(name), symbol_id) AS rank
  FROM needles n JOIN symbols s ON contains(lower(name), needle) AND s.project_id = n.project_id WHERE needle <> '')
SELECT request_id, rank, symbol_id, name, path, CASE WHEN cls = 0 THEN 'exact' ELSE 'fuzzy' END AS match,
  round(CASE WHEN cls = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END - rank * 0.001::DOUBLE, 6) AS score FROM found WHERE rank <= 20""")
def symbol_search(spark, sf):
    """Every candidate word of the whole question, whole and typed as far as its first one to four characters."""
    key = F.concat(F.col("request_id").cast("string"), F.lit(":"), F.col("candidate").cast("string"))
    begun = F.substring("name", F.lit(1), (1 + F.col("request_id") % 4).cast("int"))
    forms = F.array(F.struct(F.lit("").alias("typed"), F.col("name").alias("part")), F.struct(F.lit(":typed").alias("typed"), begun.alias("part")))
    asked = named_requests(spark, sf, None).select(key.alias("key"), "project_id", "current_file", F.explode(forms).alias("form")).select(
        F.concat("key", "form.typed").alias("request_id"), "project_id", "current_file", F.col("form.part").alias("needle")
    )
    symbols, grams = stored.names(spark, sf)
    return edges.search_symbols(asked, symbols, 20, grams).select(
        "request_id", "rank", "symbol_id", "name", "path", "match", F.round("score", 6).alias("score")
    )


@query("record_by_key", f"""WITH {co.SQL_OUTLINE}
SELECT l.doc_id AS request_id, f.path, f.source_hash, s.name, s.kind FROM labels l JOIN files f ON f.file_id = l.doc_id
LEFT JOIN symbols s ON s.symbol_id = l.doc_id * {co.LINE_STRIDE} + 1""")
def record_by_key(spark, sf):
    asked = load(spark, sf, "labels").select(
        F.col("doc_id").alias("file_id"), (F.col("doc_id") * co.LINE_STRIDE + 1).alias("symbol_id")
    )
    records = asked.join(co.files(spark, sf).select("file_id", "path", "source_hash"), "file_id")
    symbols = co.outline_symbols(spark, sf).select("symbol_id", "name", "kind")
    return records.join(symbols, "symbol_id", "left").select(
        F.col("file_id").alias("request_id"), "path", "source_hash", "name", "kind"
    )


@query("filtered_page", f"""WITH {co.SQL_OUTLINE},
rows AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path, start_line) AS rank, count(*) OVER (PARTITION BY project_id) AS total
  FROM symbols WHERE kind = 'class' AND path LIKE '%/en/%')
SELECT project_id, rank, symbol_id, total, least(total, 60) < total AS truncated,
  CASE WHEN least(total, 60) < total THEN least(total, 60)::VARCHAR END AS next_cursor FROM rows WHERE rank BETWEEN 31 AND 60""")
def filtered_page(spark, sf):
    rows = co.outline_symbols(spark, sf).filter("kind = 'class'").filter(F.col("path").contains("/en/"))
    return fx.page(rows, ["project_id"], [F.col("path"), F.col("start_line")], 30).select(
        "project_id", "rank", "symbol_id", "total", "truncated", "next_cursor"
    )


@query("calls_with_context", f"""WITH {co.SQL_OUTLINE}
SELECT c.call_id, l.path, l.line_count, c.callee_name, s.name AS caller_name, c.resolution_status, c.confidence
FROM calls c JOIN lined l USING (file_id) LEFT JOIN symbols s ON s.symbol_id = c.caller_symbol_id""")
def calls_with_context(spark, sf):
    facts = co.file_lines(spark, sf).select("file_id", "line_count")
    rows = edges.calls_with_context(co.outline_calls(spark, sf), facts, co.outline_symbols(spark, sf))
    return rows.select(
        "call_id", "path", "line_count", "callee_name", "caller_name", "resolution_status", "confidence"
    )


@query("references_by_target", f"""WITH {co.SQL_OUTLINE},
found AS (SELECT c.*, row_number() OVER (PARTITION BY target_symbol_id ORDER BY path, start_line, call_id) AS rank
  FROM calls c WHERE target_symbol_id IS NOT NULL)
SELECT target_symbol_id, rank, f.path, f.start_line, s.name AS caller_name FROM found f
LEFT JOIN symbols s ON s.symbol_id = caller_symbol_id WHERE rank <= 5""")
def references_by_target(spark, sf):
    symbols, calls = co.stored_outline(spark, sf)
    targets = symbols.select(F.col("symbol_id").alias("target_symbol_id"))
    return edges.references_to(targets, calls, symbols, 5).select(
        "target_symbol_id", "rank", "path", "start_line", "caller_name"
    )


@query("references_by_name", f"""WITH {co.SQL_OUTLINE}, {SQL_NAMED}, {SQL_GRAPH_HEADS},
near AS (SELECT a.request_id, a.candidate, h.*, row_number() OVER (PARTITION BY a.request_id, a.candidate ORDER BY
    CASE WHEN lower(h.path) = lower(a.current_file) THEN 0 ELSE 1 END, lower(h.path), h.start_line, h.path_rank) AS rank
  FROM asked a JOIN ref_heads h ON h.k = lower(a.name) AND h.project_id = a.project_id WHERE path_rank <= 20)
SELECT request_id, candidate, rank, call_id, path, coalesce(target_name, callee_name) AS symbol,
  round(0.95::DOUBLE - least(rank - 1, 20) * 0.01::DOUBLE, 6) AS score FROM near WHERE rank <= 10""")
def references_by_name(spark, sf):
    symbols, calls = co.stored_outline(spark, sf)
    asked = named_requests(spark, sf)
    heads = lookup.reference_heads(calls, symbols, 20, cut(lookup.asked_names(asked)))
    found = lookup.references(asked, heads, 10, _KEYS)
    return found.select(
        "request_id", "candidate", "rank", "call_id", "path", F.coalesce("target_name", "callee_name").alias("symbol"),
        F.round(fusion.decayed(0.95, F.col("rank")), 6).alias("score"),
    )


@query("callers_and_callees", f"""WITH {co.SQL_OUTLINE}, {SQL_NAMED}, {SQL_GRAPH_HEADS}
SELECT request_id, candidate, relation, rank, symbol_id, round(0.88::DOUBLE - least(rank - 1, 20) * 0.01::DOUBLE, 6) AS score FROM asked
JOIN (SELECT project_id, k, rank, symbol_id, 'caller' AS relation FROM caller_heads UNION ALL SELECT project_id, k, rank, symbol_id, 'callee' FROM callee_heads) h
  ON k = lower(name) AND h.project_id = asked.project_id WHERE rank <= 30""")
def callers_and_callees(spark, sf):
    symbols, calls = co.stored_outline(spark, sf)
    asked = named_requests(spark, sf)
    names = cut(lookup.asked_names(asked))
    sides = [
        lookup.neighbours(asked, lookup.neighbour_heads(calls, symbols, relation, 30, names), 30).withColumn(
            "relation", F.lit(relation)
        )
        for relation in ("caller", "callee")
    ]
    return sides[0].unionByName(sides[1]).select(
        "request_id", "candidate", "relation", "rank", "symbol_id",
        F.round(fusion.decayed(0.88, F.col("rank")), 6).alias("score"),
    )


@query("reverse_references", f"""WITH {co.SQL_OUTLINE}
SELECT target_symbol_id, caller_symbol_id, count(*) AS sites FROM calls
WHERE target_symbol_id <> caller_symbol_id GROUP BY ALL""")
def reverse_references(spark, sf):
    return edges.reverse_references(co.outline_calls(spark, sf))


SQL_MODULES = """mods AS (SELECT DISTINCT project_id, path, lower(callee_name) AS module FROM calls),
mods8 AS (SELECT project_id, path, string_agg(module, ', ' ORDER BY module) AS modules FROM (
   SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY module) AS rn FROM mods) WHERE rn <= 8 GROUP BY ALL)"""


def module_rows(spark, sf):
    return co.outline_calls(spark, sf).select("project_id", "path", F.lower("callee_name").alias("module"))


@query("imports_per_file", f"""WITH {co.SQL_OUTLINE}, {SQL_MODULES} SELECT project_id, path, modules FROM mods8""")
def imports_per_file(spark, sf):
    return repo_map.first_modules(module_rows(spark, sf))


MAP_TOKENS = 200


@query("repository_map", f"""WITH {co.SQL_OUTLINE}, {co.SQL_REQUESTS}, {SQL_MODULES},
opened AS (SELECT project_id, min(current_file) AS path FROM requests WHERE current_file IS NOT NULL GROUP BY ALL),
entries AS (SELECT project_id, path, -1 AS kn, 0 AS start_line, path || coalesce(' -> ' || modules, '') AS entry FROM files LEFT JOIN mods8 USING (project_id, path)
  UNION ALL SELECT project_id, path, CASE kind WHEN 'class' THEN 0 ELSE 1 END, start_line, '  ' || kind || ' ' || name || ': ' || trim(content) FROM symbols),
placed AS (SELECT e.*, (o.path IS NULL)::INT AS far FROM entries e LEFT JOIN opened o ON o.project_id = e.project_id AND o.path = e.path),
summed AS (SELECT *, sum(length(entry) + 1) OVER (PARTITION BY project_id ORDER BY far, path, kn, start_line) AS used FROM placed)
SELECT project_id, coalesce(string_agg(entry, chr(10) ORDER BY far, path, kn, start_line) FILTER (used <= 800), '')
   || CASE WHEN max(used) > 800 THEN CASE WHEN bool_or(used <= 800) THEN chr(10) ELSE '' END || '{repo_map.MARKER}' ELSE '' END AS map FROM summed GROUP BY project_id""")
def repository_map_query(spark, sf):
    symbols = co.outline_symbols(spark, sf).select(
        "project_id", "path", "kind", "start_line", "symbol_id", F.col("name").alias("qualified_name"), F.col("content").alias("signature"),
    )
    opened = co.requests(spark, sf).filter("current_file IS NOT NULL").groupBy("project_id").agg(F.min("current_file").alias("path"))
    return repo_map.repository_map(co.files(spark, sf), symbols, module_rows(spark, sf), MAP_TOKENS, opened)
