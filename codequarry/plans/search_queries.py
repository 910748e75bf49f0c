"""Registered queries: chunks, postings, text search, hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import chunks as ck
from codequarry.operators import fusion, lookup, search
from codequarry.plans import corpora as co
from codequarry.plans import stored
from codequarry.plans.registry import query


def chunk_rows(spark, sf, even=True):
    rows = ck.text_chunks(co.file_lines(spark, sf, even))
    return rows.withColumn("chunk_id", F.col("file_id") * co.LINE_STRIDE + F.col("start_line"))


def index(spark, sf):
    """The stored index, built by the first query that asks for it."""
    return stored.texts(spark, sf, lambda: chunk_rows(spark, sf, even=False))


SQL_CHUNKS = f"""{co.SQL_LINED},
chunks AS (
  SELECT file_id * {co.LINE_STRIDE} + s + 1 AS chunk_id, project_id, file_id, path, language, source_hash,
         s + 1 AS start_line, least(s + 80, line_count) AS end_line,
         array_to_string(lines[s + 1 : s + 80], chr(10)) AS content
  FROM (SELECT *, unnest(range(0, greatest(line_count - 11, 0) + 1, 70)) AS s FROM lined WHERE line_count > 0))"""


@query("text_chunks", f"""WITH {SQL_CHUNKS}
SELECT project_id, path, start_line, end_line, sha256(content) AS content_hash, length(content) AS chars FROM chunks""")
def text_chunks(spark, sf):
    return chunk_rows(spark, sf).select(
        "project_id", "path", "start_line", "end_line", "content_hash", F.length("content").alias("chars")
    )


SQL_TOKENS = """tokens AS (
  SELECT chunk_id, regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+') AS toks FROM chunks)"""
SQL_POSTINGS = f"""{SQL_TOKENS},
postings AS (SELECT chunk_id, dl, term, count(*) AS tf
  FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM tokens) GROUP BY ALL)"""


@query("token_counts", f"""WITH {SQL_CHUNKS}, {SQL_TOKENS}
SELECT chunk_id, len(toks) AS tokens, toks[1] AS first_token, toks[-1] AS last_token FROM tokens""")
def token_counts(spark, sf):
    tokens = tx.index_tokens(F.col("content"))
    return chunk_rows(spark, sf).select(
        "chunk_id", F.size(tokens).alias("tokens"), F.try_element_at(tokens, F.lit(1)).alias("first_token"),
        F.try_element_at(tokens, F.lit(-1)).alias("last_token"),
    )


@query("inverted_index", f"""WITH {SQL_CHUNKS}, {SQL_POSTINGS}
SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS occurrences, max(tf) AS most FROM postings GROUP BY term""")
def inverted_index(spark, sf):
    return index(spark, sf).postings.groupBy("term").agg(
        F.count("*").alias("chunks"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most")
    )


SQL_TERM = "[\\p{L}\\p{N}]+(?:_[\\p{L}\\p{N}]+)*"
SQL_BM25 = f"""{SQL_CHUNKS}, {SQL_POSTINGS}, {co.SQL_REQUESTS},
phrases AS (SELECT request_id, project_id, strip_accents(lower(t)) AS term, count(*) AS weight
  FROM (SELECT request_id, project_id, unnest(regexp_extract_all(question, '{SQL_TERM}')[:20]) AS t FROM requests) GROUP BY ALL),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM tokens),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
idfs AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6
                           ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM dfs, stats),
scored AS (SELECT request_id, chunk_id,
    round(sum(weight * idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS s
  FROM phrases p JOIN postings USING (term) JOIN idfs USING (term) JOIN chunks c USING (chunk_id), stats WHERE c.project_id = p.project_id GROUP BY ALL)"""


def sql_bm25_top(limit: int) -> str:
    return f"""ranked AS (SELECT request_id, chunk_id, -s AS bm25_score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, chunk_id) AS rank FROM scored)
      WHERE rank <= {limit})"""


@query("text_search_bm25", f"""WITH {SQL_BM25}, {sql_bm25_top(20)}
SELECT request_id, rank, path, start_line, end_line, round(bm25_score, 6) AS bm25_score,
       round(1.0 / (1.0 + abs(bm25_score)), 6) AS score
FROM ranked JOIN chunks USING (chunk_id)""")
def text_search_bm25(spark, sf):
    stored_index = index(spark, sf)
    hits = search.indexed_search(co.requests(spark, sf), stored_index, 20)
    return hits.join(stored_index.places, "chunk_id").select(
        "request_id", "rank", "path", "start_line", "end_line", F.round("bm25_score", 6).alias("bm25_score"),
        F.round(search.text_score(F.col("bm25_score")), 6).alias("score"),
    )


SQL_ASCII_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL_LITERALS = """literals AS (SELECT DISTINCT request_id, project_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS literal
  FROM (SELECT request_id, project_id, unnest(list_distinct_ordered[:8]) AS t FROM (
    SELECT request_id, project_id, list(w ORDER BY first_at) AS list_distinct_ordered FROM (
      SELECT request_id, project_id, w, min(i) AS first_at FROM (
        SELECT request_id, project_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
          SELECT request_id, project_id, list_concat(regexp_extract_all(question, '[A-Za-z_][\\p{L}\\p{N}_]*'),
                                         regexp_extract_all(question, '[\\x{3400}-\\x{9fff}]{2,}')) AS ws FROM requests))
      GROUP BY ALL) GROUP BY ALL)))"""


def sql_literal_top(limit: int) -> str:
    return f"""{SQL_LITERALS},
folded AS (SELECT project_id, chunk_id, path, start_line,
   translate(content, '{SQL_ASCII_UP}', '{SQL_ASCII_UP.lower()}') AS c FROM chunks),
literal_hits AS (SELECT request_id, chunk_id, rank FROM (
  SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY path, start_line) AS rank
  FROM (SELECT DISTINCT request_id, chunk_id, path, start_line FROM literals l JOIN folded f ON f.project_id = l.project_id AND contains(c, literal)))
  WHERE rank <= {limit})"""


@query("literal_search", f"""WITH {SQL_CHUNKS}, {co.SQL_REQUESTS}, {sql_literal_top(20)}
SELECT request_id, rank, path, start_line FROM literal_hits JOIN chunks USING (chunk_id)""")
def literal_search(spark, sf):
    stored_index = index(spark, sf)
    hits = search.indexed_literals(co.requests(spark, sf), stored_index, 20)
    return hits.join(stored_index.places, "chunk_id").select(
        "request_id", "rank", "path", "start_line"
    )


def sql_search_text(limit: int) -> str:
    return f"""{sql_bm25_top(limit)}, {sql_literal_top(limit)},
hits AS (SELECT request_id, chunk_id, bm25_score,
    row_number() OVER (PARTITION BY request_id ORDER BY fb, own) AS rank
  FROM (SELECT request_id, chunk_id, bm25_score, rank AS own, 0 AS fb FROM ranked
        UNION ALL
        SELECT request_id, chunk_id, 1000.0, rank, 1 FROM literal_hits l
        WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.request_id = l.request_id AND r.chunk_id = l.chunk_id))
  QUALIFY rank <= {limit})"""


# Enough room that the literal hits behind the ranked ones show up too.
_FILL = 1500


@query("text_search_with_fallback", f"""WITH {SQL_BM25}, {sql_search_text(_FILL)}
SELECT request_id, count(*) AS hits, count(*) FILTER (bm25_score = 1000.0) AS literal_only,
       round(min(bm25_score), 6) AS best, max(rank) AS last_rank, sum(rank * (chunk_id % 997))::BIGINT AS order_check
FROM hits GROUP BY request_id""")
def text_search_with_fallback(spark, sf):
    hits = search.search_text(co.requests(spark, sf), index(spark, sf), _FILL)
    return hits.groupBy("request_id").agg(
        F.count("*").alias("hits"), F.count_if(F.col("bm25_score") == 1000.0).alias("literal_only"),
        F.round(F.min("bm25_score"), 6).alias("best"), F.max("rank").alias("last_rank"),
        F.sum(F.col("rank") * (F.col("chunk_id") % 997)).alias("order_check"),
    )


SQL_CANDIDATES = """names AS (SELECT request_id, cand - 1 AS candidate, name FROM (
  SELECT request_id, name, row_number() OVER (PARTITION BY request_id ORDER BY first_at) AS cand FROM (
    SELECT request_id, name, min(i) AS first_at FROM (
      SELECT request_id, unnest(ws) AS name, generate_subscripts(ws, 1) AS i FROM (
        SELECT request_id, list_concat(
          CASE WHEN regexp_full_match(trim(question), '[A-Za-z_][\\p{L}\\p{N}_]*(?:\\.[A-Za-z_][\\p{L}\\p{N}_]*)?')
               THEN [string_split(trim(question), '.')[-1]] ELSE [] END,
          regexp_extract_all(question, '[A-Za-z_][\\p{L}\\p{N}_]*')) AS ws FROM requests)) GROUP BY ALL)) WHERE cand <= 12)"""

SQL_EVERY_CANDIDATE = SQL_CANDIDATES.removesuffix(" WHERE cand <= 12)") + ")"

SQL_GRAPH_HEADS = """ref_keys AS (SELECT project_id, call_id, path, start_line, end_line, callee_name, target_name, unnest(list_distinct(
    CASE WHEN target_name IS NULL THEN [lower(callee_name)] ELSE [lower(callee_name), lower(target_name)] END)) AS k
  FROM (SELECT c.*, t.name AS target_name FROM calls c LEFT JOIN symbols t ON t.symbol_id = c.target_symbol_id)),
ref_heads AS (SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY path, start_line, call_id) AS path_rank FROM ref_keys),
caller_heads AS (SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY symbol_id) AS rank FROM (
  SELECT DISTINCT t.project_id, lower(t.name) AS k, c.caller_symbol_id AS symbol_id FROM calls c
  JOIN symbols t ON t.symbol_id = c.target_symbol_id WHERE c.caller_symbol_id IS NOT NULL)),
callee_heads AS (SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY symbol_id) AS rank FROM (
  SELECT DISTINCT s.project_id, lower(s.name) AS k, c.target_symbol_id AS symbol_id FROM calls c
  JOIN symbols s ON s.symbol_id = c.caller_symbol_id WHERE c.target_symbol_id IS NOT NULL))"""


def sql_hybrid(limit: int) -> str:
    return f"""{SQL_BM25}, {sql_search_text(max(3 * limit, 20))}, {SQL_CANDIDATES},
asked AS (SELECT n.*, r.project_id, r.current_file FROM names n JOIN requests r USING (request_id)),
def_all AS (SELECT n.request_id, n.candidate, s.*, row_number() OVER (PARTITION BY n.request_id, n.candidate
    ORDER BY coalesce(path <> current_file, true)::INT, symbol_id) AS rank
  FROM asked n JOIN symbols s ON lower(s.name) = lower(n.name) AND s.project_id = n.project_id),
defs AS (SELECT request_id, candidate, rank, path, start_line, end_line, 'definition' AS relation, name AS symbol,
         1.0::DOUBLE - least(rank - 1, 20) * 0.01::DOUBLE AS score FROM def_all WHERE rank <= 5),
matched AS (SELECT DISTINCT n.* FROM asked n JOIN defs d USING (request_id, candidate)),
refs AS (SELECT request_id, candidate, rank, path, start_line, end_line, 'reference' AS relation,
         coalesce(target_name, callee_name) AS symbol, 0.95::DOUBLE - least(rank - 1, 20) * 0.01::DOUBLE AS score
  FROM (SELECT m.request_id, m.candidate, h.*, row_number() OVER (PARTITION BY m.request_id, m.candidate ORDER BY
      CASE WHEN lower(path) = lower(current_file) THEN 0 ELSE 1 END, lower(path), start_line, path_rank) AS rank
    FROM matched m JOIN ref_heads h ON k = lower(name) AND h.project_id = m.project_id WHERE path_rank <= 20) WHERE rank <= 10),
graph AS (SELECT request_id, candidate, h.rank, path, start_line, end_line, relation, s.name AS symbol,
         0.88::DOUBLE - least(h.rank - 1, 20) * 0.01::DOUBLE AS score
  FROM matched m JOIN (SELECT *, 'caller' AS relation FROM caller_heads UNION ALL
                       SELECT *, 'callee' FROM callee_heads) h ON h.k = lower(m.name) AND h.project_id = m.project_id
  JOIN symbols s USING (symbol_id) WHERE h.rank <= 6),
texts AS (SELECT request_id, 0 AS candidate, h.rank, path, start_line, end_line, 'text' AS relation, NULL::VARCHAR AS symbol,
         1.0::DOUBLE / (1.0::DOUBLE + abs(bm25_score)) AS score FROM hits h JOIN chunks USING (chunk_id)),
lists AS (
  SELECT *, 0 AS list_no, 'definitions' AS list_name, row_number() OVER (PARTITION BY request_id ORDER BY candidate, rank) AS position FROM defs
  UNION ALL SELECT *, 1, 'references', row_number() OVER (PARTITION BY request_id ORDER BY candidate, rank) FROM refs
  UNION ALL SELECT *, 2, 'graph', row_number() OVER (PARTITION BY request_id ORDER BY candidate, relation = 'callee', rank) FROM graph
  UNION ALL SELECT *, 3, 'fts5', row_number() OVER (PARTITION BY request_id ORDER BY rank) FROM texts),
fused AS (SELECT request_id, path, start_line, end_line, relation, symbol,
    round(sum(1.0::DOUBLE / (60.0::DOUBLE + position)), 12) AS rrf_score,
    round(arg_min(score, list_no * 1000000 + position), 12) AS score,
    min(list_no * 1000000 + position) AS first_seen,
    string_agg(list_name, ',' ORDER BY list_no, position) AS sources FROM lists GROUP BY ALL),
retrieved AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY
    CASE relation WHEN 'definition' THEN 0 WHEN 'reference' THEN 1 WHEN 'caller' THEN 2 WHEN 'callee' THEN 3 ELSE 4 END,
    rrf_score DESC, score DESC, lower(path), start_line, first_seen) AS rank FROM fused)"""



@query("hybrid_retrieve", f"""WITH {co.SQL_OUTLINE}, {SQL_GRAPH_HEADS},
{sql_hybrid(12).replace(SQL_CHUNKS, SQL_CHUNKS.split('FROM files))', 1)[1].lstrip(',').strip())}
SELECT request_id, rank, path, start_line, end_line, relation, coalesce(symbol, '') AS symbol,
       round(score, 6) AS score, round(rrf_score, 9) AS rrf_score, sources FROM retrieved WHERE rank <= 12""")
def hybrid_retrieve(spark, sf):
    stored_index = index(spark, sf)
    rows = fusion.hybrid_retrieve(co.requests(spark, sf), *co.stored_outline(spark, sf), stored_index.places, index=stored_index)
    return rows.select(
        "request_id", "rank", "path", "start_line", "end_line", "relation", F.coalesce("symbol", F.lit("")).alias("symbol"),
        F.round("score", 6).alias("score"), F.round("rrf_score", 9).alias("rrf_score"), "sources",
    )
