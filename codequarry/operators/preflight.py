"""Evidence preflight: everything a question needs, gathered, checked and judged in one staged job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import evidence as ev
from codequarry.operators import fusion, lookup, packing, resolve
from codequarry.operators.intervals import enclosing
from codequarry.operators.text_index import TextIndex
from codequarry.operators.topk import top_k
from codequarry.options import DEFAULTS
from codequarry.session import cut


@dataclass(frozen=True)
class Corpus:
    """files(project_id, path, language, source_hash, lines, line_count), symbols, calls, chunks and, where known, imports.

    With a stored index, chunks need no text: its places will do.
    """

    files: DataFrame
    symbols: DataFrame
    calls: DataFrame
    chunks: DataFrame
    imports: DataFrame | None = None
    index: TextIndex | None = None


_COLUMNS = ["request_id", "stage", "place", "path", "start_line", "end_line", "relation", "symbol", "score", "resolution", "symbol_id", "resolution_status", "index_hash"]
# Scores of evidence that does not come from ranked retrieval.
PREVIEW_SCORE, EXACT_SCORE, CANDIDATE_SCORE, ANCHOR_SCORE = 0.86, 1.08, 0.82, 0.92
RETRIEVED, PREFETCHED_NEIGHBOURS, NAME_LIMIT, CANDIDATES_SHOWN = 18, 6, 8, 4


def _rows(rows: DataFrame, stage: int, place: Column, relation: Column, score: Column, resolution: str | None = None) -> DataFrame:
    def known(name: str, kind: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast(kind)

    return rows.select(
        "request_id", F.lit(stage).alias("stage"), place.cast("bigint").alias("place"), "path", "start_line", "end_line", relation.alias("relation"),
        known("symbol", "string").alias("symbol"), score.cast("double").alias("score"), F.lit(resolution).cast("string").alias("resolution"),
        known("symbol_id", "bigint").alias("symbol_id"), known("resolution_status", "string").alias("resolution_status"),
        known("source_hash", "string").alias("index_hash"),
    ).select(*_COLUMNS)


def _named(requests: DataFrame, corpus: Corpus) -> DataFrame:
    """(request_id, candidate, rank, symbol_id, ...): what every name of a question means in its open file.

    With imports, a name that the open file imports means what it imports; only other names are
    looked up all over the project.
    """
    names = requests.select(
        "request_id", "project_id", "current_file", F.posexplode(tx.question_identifiers(F.col("question"))).alias("candidate", "name")
    )
    keys = ["request_id", "candidate"]
    if corpus.imports is None:
        return lookup.definitions(names, corpus.symbols, NAME_LIMIT, keys).withColumn("symbol", F.col("name"))
    asked = names.select(
        F.struct(*keys).alias("request_id"), "project_id", F.coalesce("current_file", F.lit("")).alias("path"),
        F.lit(None).cast("int").alias("line"), F.col("name").alias("expression"),
    )
    found = resolve.resolve_expressions(asked, corpus.symbols, corpus.imports, NAME_LIMIT).select("request_id.*", "rank", "symbol_id")
    details = corpus.symbols.select("project_id", "symbol_id", "path", "start_line", "end_line", F.col("name").alias("symbol"))
    return found.join(details, "symbol_id")


def gather(requests: DataFrame, corpus: Corpus, anchors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """requests(request_id, project_id, question, current_file[, line]) to (evidence rows, verdict rows).

    Stages: preview of the open file, conversation anchors, the symbol around the selected line,
    names resolved exactly or to several candidates with the direct neighbours of the exact ones,
    hybrid retrieval within the files resolved so far. Then one row per span, checked against the
    current files of the request's project, long ones windowed around the selected line.
    """
    here = corpus.files.select("project_id", "path", "source_hash", "line_count")
    opened = requests.join(here.withColumnRenamed("path", "current_file"), ["project_id", "current_file"])
    preview = opened.filter("line_count > 0").select(
        "request_id", F.col("current_file").alias("path"), F.lit(1).alias("start_line"), F.least(F.lit(DEFAULTS.preview_lines), "line_count").alias("end_line")
    )
    stages = [_rows(preview, 0, F.lit(0), F.lit("text"), F.lit(PREVIEW_SCORE))]
    if anchors is not None:
        recent = top_k(anchors, ["request_id"], [F.col("ord").desc()], DEFAULTS.anchors, "_n").join(requests.select("request_id", "project_id"), "request_id")
        live = recent.join(here.select("project_id", "path", F.col("source_hash").alias("_now")), ["project_id", "path"]).filter(
            (F.col("source_hash") == "") | (F.col("source_hash") == F.col("_now"))
        ).drop("source_hash")
        stages.append(_rows(live, 1, F.col("ord"), F.lit("definition"), F.lit(ANCHOR_SCORE), "anchor"))
    focus = requests.select("request_id", F.col("current_file").alias("path"), "line") if "line" in requests.columns else None
    if focus is not None:
        around = enclosing(
            requests.filter("line IS NOT NULL AND current_file IS NOT NULL").select("request_id", "project_id", F.col("current_file").alias("path"), "line"),
            corpus.symbols.select("project_id", "path", "symbol_id", "start_line", "end_line", F.col("name").alias("symbol")), ["project_id", "path"], 1, "request_id",
        )
        stages.append(_rows(around, 2, F.lit(-1), F.lit("definition"), F.lit(EXACT_SCORE), "enclosing"))

    keys = ["request_id", "candidate"]
    hits = cut(_named(requests, corpus))
    counts = hits.groupBy(*keys).agg(F.count("*").alias("_hits"))
    rated = hits.join(counts, keys)
    place = F.col("candidate") * 100 + F.col("rank")
    exact = rated.filter("_hits = 1")
    candidates = rated.filter((F.col("_hits") > 1) & (F.col("rank") <= CANDIDATES_SHOWN))
    stages.append(_rows(exact, 2, place, F.lit("definition"), F.lit(EXACT_SCORE), "exact"))
    stages.append(_rows(candidates, 2, place, F.lit("definition"), F.lit(CANDIDATE_SCORE), "ambiguous_candidate"))
    sure = cut(exact.select(*keys, "project_id", F.col("symbol").alias("name")))
    asked = lookup.asked_names(sure)
    for offset, relation in ((20, "caller"), (40, "callee")):
        heads = lookup.neighbour_heads(corpus.calls, corpus.symbols, relation, PREFETCHED_NEIGHBOURS, asked)
        near = lookup.neighbours(sure, heads, PREFETCHED_NEIGHBOURS).withColumn("symbol", F.col("name"))
        stages.append(_rows(near, 2, place + offset, F.lit(relation), fusion.decayed(fusion.TOP_SCORE[relation], F.col("rank"))))

    resolved = requests.select("request_id", F.col("current_file").alias("path")).unionByName(exact.select("request_id", "path")).unionByName(
        candidates.select("request_id", "path")
    )
    retrieved = fusion.hybrid_retrieve(requests, corpus.symbols, corpus.calls, corpus.chunks, RETRIEVED, corpus.index)
    stages.append(_rows(ev.restrict_scope(retrieved, resolved), 3, F.col("rank"), F.col("relation"), F.col("score")))

    gathered = stages[0]
    for rows in stages[1:]:
        gathered = gathered.unionByName(rows)
    # A request's rows are few by now, so their order is a plain number, whatever the stages' own places are.
    turn = Window.partitionBy("request_id").orderBy("stage", "place", "path", "start_line", "end_line", "relation", "symbol")
    ordered = gathered.withColumn("ord", F.row_number().over(turn)).drop("stage", "place")
    once = cut(ev.prefer_resolved(ordered).join(requests.select("request_id", "project_id"), "request_id"))
    # Spans come from the index: out of bounds or indexed under another hash, they drop out.
    span = ["project_id", *ev.SPAN]
    # Written first, the spans have an exact size, so the files' texts need not be shuffled to meet few of them.
    texts = cut(once.select(*span).distinct()).join(corpus.files.select("project_id", "path", "source_hash", "language", "lines"), ["project_id", "path"]).select(
        *span, "source_hash", "language", tx.span_of(F.col("lines"), F.col("start_line"), F.col("end_line")).alias("content")
    ).filter("content IS NOT NULL")
    whole = once.join(texts, span).filter(F.col("index_hash").isNull() | (F.col("index_hash") == "") | (F.col("index_hash") == F.col("source_hash"))).drop("index_hash")
    if focus is None:
        whole = whole.withColumn("_focus", F.lit(None).cast("int"))
    else:
        whole = whole.join(focus.select("request_id", "path", F.col("line").cast("int").alias("_focus")), ["request_id", "path"], "left")
    windows = packing.definition_windows(F.col("start_line"), F.col("end_line"), F.col("_focus"))
    pieces = cut(whole.withColumn("_w", F.explode(windows)).select(
        *[c for c in whole.columns if c not in ("start_line", "end_line", "content", "_focus")],
        (F.col("start_line") + F.col("_w.a")).alias("start_line"), (F.col("start_line") + F.col("_w.b")).alias("end_line"),
        tx.join_lines(F.slice(tx.lines_of(F.col("content")), F.col("_w.a") + 1, F.col("_w.b") - F.col("_w.a") + 1)).alias("content"),
    ))
    several = counts.filter("_hits > 1").select("request_id").distinct().withColumn("ambiguous", F.lit(True))
    questions = requests.select("request_id", "question").join(several, "request_id", "left").na.fill(False, ["ambiguous"])
    return pieces, ev.preflight_verdict(questions, pieces)
