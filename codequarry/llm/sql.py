"""The SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from codequarry.llm.quality_rules import RULES, STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for group in STOP_WORDS.values() for w in group}))
_BOUNDS = " AND ".join(
    " AND ".join([f"{r.measure} >= {r.low}" for _ in "x" if r.low is not None] + [f"{r.measure} <= {r.high}" for _ in "x" if r.high is not None]) for r in RULES
)

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
    SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
),
windows AS (
    SELECT rid, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)
),
twice AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w1, w2) AS n FROM windows WHERE w2 IS NOT NULL) WHERE n > 1
),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
counted AS (SELECT rid, count(*) AS n, sum(length(w)) AS chars FROM words GROUP BY rid),
lines AS (
    SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
    FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
),
measured AS (
    SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_words, coalesce(c.chars, 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D!-/:-@\[-`{{-~]+'), lambda x: list_contains([{_STOPS}], x))) AS n_stop,
        len(list_filter(regexp_extract_all(t, '\p{{L}}+'), lambda x: regexp_full_match(x, '\p{{Lu}}{{2,}}'))) AS n_capital
    FROM d LEFT JOIN counted c USING (rid) LEFT JOIN covered v USING (rid) LEFT JOIN lines l USING (rid)
),
rated AS (
    SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
        CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_word_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
        CASE WHEN n_words > 0 THEN n_capital / n_words ELSE 0 END AS capital_word_ratio,
        (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_BOUNDS}) AS kept FROM rated
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""
WITH dw AS (
    SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT row_number() OVER () AS rid, regexp_extract_all({_FOLDED}, '{_CHARS}') AS ws FROM documents)
),
items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, row_number() OVER () AS k, regexp_extract_all({_FOLDED}, '{_CHARS}') AS ws FROM benchmark
),
windows AS (
    SELECT item, k, p, least(10, len(ws)) AS size, array_to_string(list_slice(ws, p, p + 9), ' ') AS win
    FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM items WHERE len(ws) > 0)
),
grams AS (
    SELECT rid, i, s AS size, string_agg(w, ' ') OVER (PARTITION BY rid, s ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS win,
        count(*) OVER (PARTITION BY rid, s ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n
    FROM dw, (SELECT 10 AS s)
),
short AS (
    SELECT g.rid, g.i, t.size, t.item, t.k, t.p FROM grams g JOIN (SELECT * FROM windows WHERE size < 10) t
    ON g.n >= t.size AND array_to_string(list_slice(string_split(g.win, ' '), 1, t.size), ' ') = t.win
),
found AS (
    SELECT g.rid, g.i, t.size, t.item, t.k, t.p FROM grams g JOIN windows t ON t.size = 10 AND g.n = 10 AND g.win = t.win
    UNION ALL SELECT * FROM short
),
runs AS (
    SELECT rid, item, k, min(i) AS a, max(i + size) AS b
    FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, k, i - p ORDER BY i) AS island FROM (SELECT DISTINCT * FROM found)) GROUP BY rid, item, k, i - p, island
),
hit AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS x FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid),
counted AS (SELECT rid, count(*) AS n FROM dw GROUP BY rid),
longest AS (SELECT rid, max(b - a) AS n FROM runs GROUP BY rid)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
    sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, coalesce(l.n, 0)::BIGINT AS longest
FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d
LEFT JOIN counted c USING (rid) LEFT JOIN hit h USING (rid) LEFT JOIN named m USING (rid) LEFT JOIN longest l USING (rid)
"""

MIX = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        coalesce(doc_id::VARCHAR, 'null') AS id, md5(coalesce(text, '')) AS digest,
        (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM documents
),
totals AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source
),
weighed AS (SELECT source, source_size, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals),
ranked AS (
    SELECT *, coalesce(sum(source_size) OVER before, 0)::BIGINT AS size_before,
        (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS weight_left, (sum(source_size) OVER ())::BIGINT AS total
    FROM weighed WINDOW before AS (ORDER BY source_size * 10 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
levelled AS (SELECT *, (total - 3 * size_before) / weight_left AS level FROM ranked),
capped AS (SELECT *, 3 * source_size <= level * weight AS cap FROM levelled),
targets AS (
    SELECT source, source_size, CASE WHEN cap THEN (3 * source_size)::DOUBLE
        ELSE weight * (SELECT min_by(level, size_before) FROM capped WHERE NOT cap) END AS target FROM capped
),
shares AS (
    SELECT source, source_size, target, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole FROM targets
),
rests AS (SELECT *, target - whole * source_size AS rest FROM shares),
placed AS (
    SELECT s.*, source_size, target, whole, rest,
        CASE WHEN rest > 0 AND size > 0 THEN u / (1.0::DOUBLE - u) / ((rest / source_size) / (1.0::DOUBLE - rest / source_size) / (1.0::DOUBLE + size / rest)) END AS ratio
    FROM sized s JOIN rests t ON s.source IS NOT DISTINCT FROM t.source
),
running AS (
    SELECT source, ratio, id, digest, sum(size) AS words, any_value(rest) AS rest,
        sum(sum(size)) OVER (PARTITION BY source ORDER BY ratio, id, digest) AS upto
    FROM placed WHERE ratio IS NOT NULL GROUP BY source, ratio, id, digest
),
-- The step that holds the cut is closed by the running sum reaching the rest; places past it are out.
taken AS (SELECT source, ratio, id, digest FROM running WHERE upto * 2 - words <= rest * 2)
SELECT p.doc_id, p.size, p.source_size::BIGINT AS source_size, p.target, ((p.whole + CASE WHEN t.id IS NULL THEN 0 ELSE 1 END) * p.size)::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.source IS NOT DISTINCT FROM t.source AND p.ratio = t.ratio AND p.id = t.id AND p.digest = t.digest
"""

def cluster_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd's rounds over whole numbers: assign to the nearest, floor the means, and assign once more."""
    assigned = """a{r} AS MATERIALIZED (
    SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, j := j)) AS best FROM (
        SELECT rid, vec_id, v, j, list_sum(list_transform(range(1, {dims} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM v CROSS JOIN c{r}
    ) GROUP BY rid
)"""
    moved = """s{r} AS (
    SELECT j, list(CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END ORDER BY i) AS c FROM (
        SELECT best.j AS j, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, {dims} + 1) t(i) GROUP BY best.j, i
    ) GROUP BY j
),
c{next} AS MATERIALIZED (SELECT c{r}.j, coalesce(list_transform(s{r}.c, lambda x: x::BIGINT), c{r}.c) AS c FROM c{r} LEFT JOIN s{r} USING (j))"""
    steps = [part.format(r=r, next=r + 1, dims=dims) for r in range(rounds) for part in (assigned, moved)]
    steps.append(assigned.format(r=rounds, dims=dims))
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id,
        list_transform(embedding, lambda x: greatest(least(floor(256.0::DOUBLE * x::DOUBLE), 134217728), -134217728)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
),
c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS j, v AS c
    FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k})
),
{",".join(chr(10) + step for step in steps).strip()},
named AS (SELECT j, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, best.j::INTEGER AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.j))::BIGINT AS cluster_inertia,
    (sum(best.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN named ON best.j = named.j
"""


MINHASH = r"""
WITH RECURSIVE worded AS (
    SELECT row_number() OVER () AS rid, doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda w: w <> '') AS w
    FROM documents
),
shingled AS MATERIALIZED (
    SELECT rid, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM worded
),
keyed AS MATERIALIZED (SELECT rid, doc_id, s, len(s) AS n, sha256(array_to_string(list_sort(s), '|')) AS key FROM shingled),
sets AS MATERIALIZED (SELECT key, any_value(n) AS n, min(doc_id) AS first_id, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY key),
items AS MATERIALIZED (SELECT key, n, unnest(s) AS x FROM sets),
shared AS (
    SELECT a.key AS a, b.key AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
    FROM items a JOIN items b ON a.x = b.x AND a.key <> b.key AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.key, b.key
),
linked AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * i >= 85 * (na + nb - i)),
reach AS (SELECT key AS start, key AS node FROM sets UNION SELECT r.start, l.b FROM reach r JOIN linked l ON l.a = r.node),
rooted AS (SELECT start, min(first_id) AS component_id FROM reach JOIN sets ON node = key GROUP BY start)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE r.component_id END AS component_id,
    k.doc_id IS NOT DISTINCT FROM CASE WHEN k.n = 0 THEN k.doc_id ELSE r.component_id END AS kept
FROM keyed k LEFT JOIN rooted r ON k.key = r.start AND k.n > 0
"""
