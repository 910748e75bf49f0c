"""Full-text search over chunks or their stored index: BM25 over phrases, and the literal fallback.

Chunks need chunk_id, project_id, content, path, start_line; requests need project_id. Statistics
cover every chunk given, candidates and cuts only the request's own project. For statistics of one
project, give only its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators.lookup import containing, containing_in
from codequarry.operators.text_index import TextIndex
from codequarry.operators.topk import top_k
from codequarry.session import cut

# The ranking constants of the full-text engine being matched.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
# Sums of doubles in another order differ by less than this.
SCORE_SLACK = 1e-8
# So many times the chunks that are wanted are asked before the rest of a project.
FRONT = 3
# The first chunks of a project that are asked next, where that is more. They fill all but rare literals.
DEEP = 3000
# Fixed value: the score literal hits carry.
LITERAL_SCORE = 1000.0


def postings(chunks: DataFrame) -> DataFrame:
    """One row per (chunk, term): its count, and the chunk's token count. The derived search table."""
    tokens = chunks.select("chunk_id", tx.index_tokens(F.col("content")).alias("tokens"))
    flat = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return flat.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def request_phrases(requests: DataFrame, text: str = "question") -> DataFrame:
    """(request_id, project_id, phrase, parts, weight): a phrase asked twice weighs twice."""
    terms = requests.select("request_id", "project_id", F.explode(tx.fts_terms(F.col(text))).alias("term"))
    parts = terms.select("request_id", "project_id", tx.index_tokens(F.col("term")).alias("parts")).filter(F.size("parts") > 0)
    return parts.groupBy("request_id", "project_id", F.array_join("parts", " ").alias("phrase"), "parts").agg(
        F.count("*").alias("weight")
    )


def phrase_counts(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, project_id, chunk_id, dl, tf) for the distinct phrases asked, and one row with the phrase "" per chunk.

    Tokens meet the asked terms before anything is shuffled. The empty phrase carries the corpus
    statistics, so one pass over the text yields all a score needs. One-word phrases count directly;
    longer ones match every word at its offset and need all of them at one start.
    """
    wanted = phrases.select("phrase", "parts").distinct()
    tokens = chunks.select("project_id", "chunk_id", tx.index_tokens(F.col("content")).alias("tokens"))
    flat = tokens.select(
        "project_id", "chunk_id", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term")
    )
    everywhere = phrases.sparkSession.range(1).select(F.lit("").alias("term"))
    single = wanted.filter(F.size("parts") == 1).select(F.col("phrase").alias("term")).unionByName(everywhere)
    ones = flat.join(single, "term").groupBy(F.col("term").alias("phrase"), "project_id", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    longer = wanted.filter(F.size("parts") > 1)
    if longer.isEmpty():
        return ones
    words = longer.select("phrase", F.size("parts").alias("words"), F.posexplode("parts").alias("offset", "term"))
    placed = tokens.select("project_id", "chunk_id", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "term"))
    starts = placed.join(words, "term").groupBy(
        "phrase", "words", "project_id", "chunk_id", "dl", (F.col("pos") - F.col("offset")).alias("start")
    ).agg(F.count("*").alias("hits"))
    many = starts.filter("hits = words").groupBy("phrase", "project_id", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    return ones.unionByName(many)


def bm25_search(requests: DataFrame, chunks: DataFrame, limit: int, text: str = "question") -> DataFrame:
    """Best `limit` chunks per request: request_id, chunk_id, bm25_score (lower is better), rank."""
    # Written once, the phrases have an exact size, which decides whether they are broadcast.
    phrases = cut(request_phrases(requests, text))
    counts = cut(phrase_counts(chunks, phrases))
    stats = counts.filter("phrase = ''").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    return _ranked(phrases, counts.filter("phrase <> ''"), stats, limit)


def indexed_search(requests: DataFrame, index: TextIndex, limit: int, text: str = "question") -> DataFrame:
    """The same answer from the stored index: only the postings of the asked terms are read."""
    phrases = cut(request_phrases(requests, text))
    stats = index.stats.agg(F.sum("chunks").cast("double").alias("n"), (F.sum("tokens") / F.sum("chunks")).alias("avgdl"))
    return _ranked(phrases, cut(indexed_counts(index, phrases)), stats, limit)


def indexed_counts(index: TextIndex, phrases: DataFrame) -> DataFrame:
    """(phrase, project_id, chunk_id, dl, tf) of the distinct phrases asked. Words of longer ones meet by their positions."""
    wanted = cut(phrases.select("phrase", "parts").distinct())
    columns = ["phrase", "project_id", "chunk_id", "dl", "tf"]
    ones = index.postings.join(wanted.filter(F.size("parts") == 1).select("phrase", F.col("phrase").alias("term")), "term").select(*columns)
    longer = wanted.filter(F.size("parts") > 1)
    if longer.isEmpty():
        return ones
    words = longer.select("phrase", F.size("parts").alias("words"), F.posexplode("parts").alias("offset", "term"))
    placed = index.postings.join(words, "term").select(
        "phrase", "words", "project_id", "chunk_id", "dl", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start")
    )
    starts = placed.groupBy("phrase", "words", "project_id", "chunk_id", "dl", "start").agg(F.count("*").alias("hits"))
    many = starts.filter("hits = words").groupBy("phrase", "project_id", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    return ones.unionByName(many.select(*columns))


def _ranked(phrases: DataFrame, matched: DataFrame, stats: DataFrame, limit: int) -> DataFrame:
    """The best chunks of every request, given what its phrases match and one row of corpus statistics.

    A phrase in half of all chunks or more has the floor idf. Its matches are most of all, and each adds
    less than its worth times K1 + 1. So the other phrases are summed first, and only chunks that could
    still reach the request's last place are looked up in the common phrases' matches. A request whose
    other phrases leave places free takes all of them.
    """
    total, mean_length = stats.select("n").scalar(), stats.select("avgdl").scalar()
    spread = matched.groupBy("phrase").agg(F.count("*").alias("df"))
    raw_idf = F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw_idf <= 0, F.lit(IDF_FLOOR)).otherwise(raw_idf)
    # Weight and idf meet on the small side, before the join multiplies the rows.
    asked = cut(
        phrases.select("request_id", "project_id", "phrase", "weight").join(spread, "phrase").select(
            "request_id", "project_id", "phrase", (F.col("weight") * idf).alias("worth"), (raw_idf <= 0).alias("common")
        )
    )
    saturation = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean_length))
    weighed = matched.select("phrase", "project_id", "chunk_id", saturation.alias("part"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("request_id", "chunk_id").agg(F.sum(F.col("worth") * F.col("part")).alias("_sum"))

    common = asked.filter("common")
    scores = summed(weighed.join(asked.filter("NOT common"), ["project_id", "phrase"]))
    if not common.isEmpty():
        rare = cut(scores)
        last = top_k(rare, ["request_id"], [F.col("_sum").desc()], limit, "_n").filter(F.col("_n") == limit).select("request_id", F.col("_sum").alias("_edge"))
        most = common.groupBy("request_id").agg((F.sum("worth") * (K1 + 1)).alias("_most"))
        edges = cut(last.join(most, "request_id", "left").select("request_id", (F.col("_edge") - F.coalesce("_most", F.lit(0.0)) - SCORE_SLACK).alias("_edge")))
        alive = cut(rare.join(edges, "request_id", "left").filter(F.col("_edge").isNull() | (F.col("_sum") >= F.col("_edge"))).drop("_edge"))
        closed = common.join(edges.select("request_id"), "request_id", "left_semi").join(alive.select("request_id", "chunk_id"), "request_id")
        inside = summed(weighed.join(closed, ["project_id", "phrase", "chunk_id"]))
        anywhere = summed(weighed.join(common.join(edges.select("request_id"), "request_id", "left_anti"), ["project_id", "phrase"]))
        scores = alive.unionByName(inside).unionByName(anywhere).groupBy("request_id", "chunk_id").agg(F.sum("_sum").alias("_sum"))
    rounded = scores.select("request_id", "chunk_id", F.round("_sum", 9).alias("_score"))
    best = top_k(rounded, ["request_id"], [F.col("_score").desc(), F.col("chunk_id")], limit)
    return best.select("request_id", "chunk_id", (-F.col("_score")).alias("bm25_score"), "rank")


def _literals(requests: DataFrame, text: str) -> DataFrame:
    return cut(
        requests.select("request_id", "project_id", F.explode(tx.literal_terms(F.col(text))).alias("literal")).select(
            "request_id", "project_id", tx.ascii_lower(F.col("literal")).alias("literal")
        ).distinct()
    )


def literal_search(requests: DataFrame, chunks: DataFrame, limit: int, text: str = "question") -> DataFrame:
    """First `limit` chunks by (path, start_line) containing any literal of the request.

    A literal consists of word characters only, so any occurrence lies inside one run of word
    characters. It is therefore matched against the distinct runs of the asked projects, and only
    the first `limit` chunks of a project's run can matter to the answer.
    """
    literals = _literals(requests, text)
    runs = F.array_distinct(F.regexp_extract_all(tx.ascii_lower(F.col("content")), F.lit(tx.WORD_RUN), 0))
    wanted = literals.select("project_id").distinct()
    flat = chunks.join(wanted, "project_id", "left_semi").select("project_id", "chunk_id", "path", "start_line", F.explode(runs).alias("run"))
    heads = cut(_run_heads(flat, limit))
    pairs = cut(containing(literals.select("literal").distinct(), heads.select("run").distinct(), "literal", "run"))
    return _literal_hits(literals, pairs, heads, limit)


def indexed_literals(requests: DataFrame, index: TextIndex, limit: int, text: str = "question") -> DataFrame:
    """The same answer from the stored places, runs and grams.

    A literal of a few letters lies in most runs and finds its first chunks at once, among the first ones
    of the project. So these are asked first, then more of them; only literals that they don't fill meet all
    runs, through the stored grams.
    """
    literals = _literals(requests, text)
    place = [F.col("path"), F.col("start_line")]
    unfilled = cut(literals.select("project_id", "literal").distinct())
    hits = None
    for width in sorted({FRONT * limit, max(DEEP, FRONT * limit)}):
        asked = index.places.join(cut(unfilled.select("project_id").distinct()), "project_id", "left_semi")
        front = cut(top_k(asked, ["project_id"], place, width, "_n").select("project_id", "path", "chunk_id"))
        near = cut(index.runs.join(front, ["project_id", "path", "chunk_id"], "left_semi").select("project_id", "chunk_id", "path", "start_line", "run"))
        pairs = cut(containing(unfilled.select("literal").distinct(), near.select("run").distinct(), "literal", "run"))
        first = pairs.join(near, "run").join(unfilled, ["project_id", "literal"])
        found = cut(top_k(first.select("project_id", "literal", "chunk_id", "path", "start_line").distinct(), ["project_id", "literal"], place, limit, "_n"))
        filled = found.filter(F.col("_n") == limit).select("project_id", "literal")
        full = found.join(filled, ["project_id", "literal"], "left_semi").drop("_n")
        hits = full if hits is None else hits.unionByName(full)
        unfilled = cut(unfilled.join(filled, ["project_id", "literal"], "left_anti"))
    pairs = cut(containing_in(unfilled.select("literal").distinct(), index.grams.withColumnRenamed("word", "run"), "literal", "run"))
    held = index.runs.join(cut(pairs.select("run").distinct()), "run", "left_semi").join(cut(unfilled.select("project_id").distinct()), "project_id", "left_semi")
    rest = pairs.join(_run_heads(held, limit), "run").join(unfilled, ["project_id", "literal"])
    return _first_chunks(literals, hits.unionByName(rest.select("project_id", "literal", "chunk_id", "path", "start_line").distinct()), limit)


def _run_heads(runs: DataFrame, limit: int) -> DataFrame:
    held = runs.select("project_id", "chunk_id", "path", "start_line", "run")
    return top_k(held, ["project_id", "run"], [F.col("path"), F.col("start_line")], limit, "_n").drop("_n")


def _literal_hits(literals: DataFrame, pairs: DataFrame, heads: DataFrame, limit: int) -> DataFrame:
    return _first_chunks(literals, pairs.join(heads, "run").select("project_id", "literal", "chunk_id", "path", "start_line").distinct(), limit)


def _first_chunks(literals: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """The first chunks of every request, given at least the first ones of each of its literals."""
    place = [F.col("path"), F.col("start_line")]
    per_literal = top_k(hits, ["project_id", "literal"], place, limit, "_n").drop("_n")
    found = literals.join(per_literal, ["project_id", "literal"]).select("request_id", "chunk_id", "path", "start_line").distinct()
    return top_k(found, ["request_id"], place, limit).select("request_id", "chunk_id", "rank")


def search_text(requests: DataFrame, chunks: DataFrame | TextIndex, limit: int, text: str = "question") -> DataFrame:
    """BM25 hits, filled up with literal hits not among them: chunk_id, bm25_score, rank. Chunks, or their stored index.

    Literal hits come last, so only requests with fewer than `limit` BM25 hits are searched for them.
    """
    stored = isinstance(chunks, TextIndex)
    ranked = cut((indexed_search if stored else bm25_search)(requests, chunks, limit, text))
    full = ranked.filter(F.col("rank") == limit).select("request_id")
    short = cut(requests.join(full, "request_id", "left_anti"))
    if short.isEmpty():
        return ranked
    literal = (indexed_literals if stored else literal_search)(short, chunks, limit, text).join(
        ranked.select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_anti"
    ).select(
        "request_id", "chunk_id", F.lit(LITERAL_SCORE).alias("bm25_score"), "rank", F.lit(1).alias("_fallback")
    )
    both = ranked.withColumn("_fallback", F.lit(0)).unionByName(literal).withColumnRenamed("rank", "_own")
    return top_k(both, ["request_id"], [F.col("_fallback"), F.col("_own")], limit).drop("_own", "_fallback")


def text_score(bm25):
    """Weaker matches get higher scores here; fusion orders by rank first, so this only breaks ties."""
    return 1.0 / (1.0 + F.abs(bm25))
