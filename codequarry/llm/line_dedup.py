"""Line dedup by winnowing over word hashes.

A text is cut into words, each with the white space after it up to its line's end. Every run of
`run_words` words is compared, wherever it begins or ends in a line; white space around a word doesn't
count. The smallest hash of a few successive words of a run is its fingerprint (winnowing: a repeated
run always repeats its fingerprint, and neighbouring runs mostly share theirs).

 1. Each task hashes the runs of its documents and keeps the first of equal ones; the others are
    repeats already. So a passage that a third of all documents share is sent once per task.
 2. The fingerprint names the shard of a run; neighbouring runs with one fingerprint travel together, so
    a run costs 8 bytes and a share of their head. Runs that could be equal meet there, once: the first
    in the order of documents is the source, all others are repeats of it. Every occurrence meets one
    source, never all other occurrences.
 3. Neighbouring runs that repeat are one interval; the union of the intervals is deleted.

So a word goes exactly if it lies in a run of at least `run_words` words that stands in an earlier
document, or earlier in the same one. Documents are ordered by id, nulls last.

Defined results: null texts stay null, empty ones empty; rows equal in id and text are one document
and keep the same words; a document whose every word repeats becomes the empty text; columns other
than `text` and its length stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import Carried, pick, row_key
from codequarry.session import cut

#: Words that make a repeat.
RUN_WORDS = 30
#: Successive words whose hash can be a fingerprint; single words would crowd the shards of frequent ones.
GRAM = 8

_PIECE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*\n?|[\x20\x09\x0B-\x0D]*\n|[\x20\x09\x0B-\x0D]+")
_BLANK = " \t\n\v\f\r"


def pieces(text: str) -> list[str]:
    """Words with the white space after them, and blank pieces, that add up to the text."""
    return _PIECE.findall(text)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, in order."""
    # Splitting bytes uses exactly the six white-space bytes of the word rule.
    own = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, own), dtype=np.uint64, count=len(own))


def is_word(piece: str) -> bool:
    """A piece begins with its word, if it has one."""
    return piece[0] not in _BLANK


@dataclass
class Runs:
    """Runs of the texts of one block: text, first word, hash, and the hash of the fingerprint."""

    text: np.ndarray
    start: np.ndarray
    run: np.ndarray
    fingerprint: np.ndarray


def _mix(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def runs_of(words: list[np.ndarray], run_words: int = RUN_WORDS) -> Runs:
    """All runs of a block of texts, given by the hashes of their words, in order."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    n = int(sizes.sum())
    hashes = np.concatenate(words) if n else np.zeros(0, dtype=np.uint64)
    text = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    start = np.flatnonzero(np.arange(n) + run_words <= np.repeat(ends, sizes))
    if not len(start):
        none = np.zeros(0, dtype=np.uint64)
        return Runs(start, start, none, none)
    # Hash of words [i, i + k): differences of a running sum in powers of an odd number, brought to power zero.
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    inverse = np.cumprod(np.full(n, back, dtype=np.uint64), dtype=np.uint64)
    summed = np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)
    summed *= hashes
    summed = np.concatenate([[np.uint64(0)], np.cumsum(summed, dtype=np.uint64)])
    run = _mix((summed[run_words:] - summed[:-run_words])[start] * inverse[start])
    gram = min(GRAM, run_words)
    smallest = _mix((summed[gram:] - summed[:-gram]) * inverse[: n - gram + 1])
    # Smallest of `width` neighbours, doubling.
    width, have = run_words - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        smallest = np.minimum(smallest[:-step], smallest[step:])
        have += step
    own = text[start]
    return Runs(own, start - (ends - sizes)[own], run, smallest[start])


#: Characters of text in one block, which bounds a task's memory.
BLOCK_CHARS = 8_000_000
#: Bytes of text whose runs make one shard, which is held whole in a task.
SHARD_BYTES = 16_000_000
#: Neighbouring runs of one shard: their document, its id, the first word of the first and how many there are.
_HEAD = np.dtype([("rid", "<i8"), ("doc", "<i8"), ("start", "<u4"), ("count", "<u4"), ("no_id", "u1")])
_RUN = np.dtype([("run", "<u8"), ("rid", "<i8"), ("doc", "<i8"), ("start", "<u4"), ("no_id", "u1")])
_REPEAT = "rid bigint, doc_id bigint, start bigint, stop bigint, source_rid bigint, source_doc_id bigint, source_start bigint"


def _found(rows: np.ndarray, first: np.ndarray, run_words: int) -> pa.Table:
    """Repeats, given each run and its source: neighbouring runs whose sources are neighbours are one interval."""
    mine = (rows["rid"] != first["rid"]) | (rows["start"] != first["start"])
    rows, first = rows[mine], first[mine]
    order = np.lexsort((rows["start"], rows["rid"]))
    rows, first = rows[order], first[order]
    # A document that several blocks hold gives each of its runs several times.
    again = (rows["rid"][1:] == rows["rid"][:-1]) & (rows["start"][1:] == rows["start"][:-1])
    fresh = np.append(True, ~again)[: len(rows)]
    rows, first = rows[fresh], first[fresh]
    along = lambda r: (r["rid"][1:] == r["rid"][:-1]) & (r["start"][1:].astype(np.int64) == r["start"][:-1].astype(np.int64) + 1)
    heads = np.flatnonzero(np.append(True, ~(along(rows) & along(first)))[: len(rows)])
    lasts = np.append(heads[1:], len(rows))[: len(heads)] - 1
    ids = lambda r: pa.array(r["doc"], mask=r["no_id"] == 1)
    stop = rows["start"][lasts].astype(np.int64) + run_words
    rows, first = rows[heads], first[heads]
    return pa.table({
        "rid": pa.array(rows["rid"]), "doc_id": ids(rows), "start": pa.array(rows["start"].astype(np.int64)), "stop": pa.array(stop),
        "source_rid": pa.array(first["rid"]), "source_doc_id": ids(first), "source_start": pa.array(first["start"].astype(np.int64)),
    })


def _blocks(plain: DataFrame, run_words: int, shards: int) -> DataFrame:
    """Per block and shard the first occurrences of its runs, packed; repeats within a block as rows of a stream."""

    def packed(docs: dict[int, tuple[bool, int, np.ndarray]]) -> pa.RecordBatch:
        # In the order of documents, so the first of equal runs is the source.
        rids = sorted(docs, key=lambda r: (docs[r][0], docs[r][1], r))
        found = runs_of([docs[r][2] for r in rids], run_words)
        rid = np.array(rids, dtype=np.int64)
        no_id = np.array([docs[r][0] for r in rids], dtype=np.uint8)
        doc = np.array([docs[r][1] for r in rids], dtype=np.int64)

        def rows_at(at: np.ndarray) -> np.ndarray:
            rows = np.zeros(len(at), dtype=_RUN)
            own = found.text[at]
            rows["rid"], rows["doc"], rows["no_id"], rows["start"] = rid[own], doc[own], no_id[own], found.start[at]
            return rows

        n = len(found.run)
        order = np.argsort(found.run)
        same = found.run[order[1:]] == found.run[order[:-1]]
        heads = np.flatnonzero(np.append(True, ~same)[:n])
        # Of equal runs the first is the source, in whatever order they came.
        source = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, n))) if n else order
        later = source != order
        table = _found(rows_at(order[later]), rows_at(source[later]), run_words)
        kept = np.sort(source[heads])
        shard_of = (found.fingerprint[kept] % np.uint64(shards)).astype(np.int64)
        text = found.text[kept]
        fresh = np.append(True, (kept[1:] != kept[:-1] + 1) | (shard_of[1:] != shard_of[:-1]) | (text[1:] != text[:-1]))[: len(kept)]
        at = np.flatnonzero(fresh)
        together = np.zeros(len(at), dtype=_HEAD)
        for name in ("rid", "doc", "no_id", "start"):
            together[name] = rows_at(kept[at])[name]
        together["count"] = np.diff(np.append(at, len(kept)))
        own = shard_of[at]
        dealt = np.argsort(own, kind="stable")
        runs = found.run[kept][np.argsort(shard_of, kind="stable")]
        together, own = together[dealt], own[dealt]
        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
        stops = np.append(cuts[1:], len(own))[: len(cuts)]
        upto = np.concatenate([[0], np.cumsum(together["count"], dtype=np.int64)])
        data = [np.int64(b - a).tobytes() + together[a:b].tobytes() + runs[upto[a] : upto[b]].tobytes() for a, b in zip(cuts, stops, strict=True)]
        names = [int(own[a]) for a in cuts]
        kinds = [False] * len(names)
        if table.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            data, names, kinds = [*data, sink.getvalue().to_pybytes()], [*names, int(rids[0]) % shards], [*kinds, True]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(kinds, pa.bool_()), pa.array(data, pa.binary())], ["shard", "done", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size = {}, 0
        for batch in batches:
            for rid, doc_id, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if rid in docs:
                    continue
                text = item.as_py()
                docs[rid] = (doc_id is None, doc_id or 0, word_hashes(text))
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield packed(docs)
                    docs, size = {}, 0
        if docs:
            yield packed(docs)

    return plain.mapInArrow(run, "shard bigint, done boolean, data binary")


def _meet(table: pa.Table, run_words: int) -> pa.Table:
    """All repeats of one shard: those found within blocks, and those between them."""
    heads, runs, passed = [], [], []
    for done, item in zip(table.column("done").to_pylist(), table.column("data"), strict=True):
        data = item.as_py()
        if done:
            passed.append(pa.ipc.open_stream(data).read_all())
        else:
            n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
            heads.append(np.frombuffer(data, dtype=_HEAD, count=n, offset=8))
            runs.append(np.frombuffer(data, dtype=np.uint64, offset=8 + n * _HEAD.itemsize))
    head = np.concatenate(heads) if heads else np.zeros(0, dtype=_HEAD)
    run = np.concatenate(runs) if runs else np.zeros(0, dtype=np.uint64)
    upto = np.concatenate([[0], np.cumsum(head["count"], dtype=np.int64)])
    # Most runs are found once; only the others are put in order.
    order = np.argsort(run)
    same = run[order[1:]] == run[order[:-1]]
    at = order[(np.append(False, same) | np.append(same, False))[: len(order)]]
    own = np.searchsorted(upto, at, side="right") - 1
    rows = np.zeros(len(at), dtype=_RUN)
    rows["run"], rows["start"] = run[at], head["start"][own] + (at - upto[own])
    for name in ("rid", "doc", "no_id"):
        rows[name] = head[name][own]
    rows = rows[np.lexsort((rows["start"], rows["rid"], rows["doc"], rows["no_id"], rows["run"]))]
    firsts = np.flatnonzero(np.append(True, rows["run"][1:] != rows["run"][:-1])[: len(rows)])
    source = np.repeat(firsts, np.diff(np.append(firsts, len(rows))))
    return pa.concat_tables([*passed, _found(rows, rows[source], run_words)])


def _shards(plain: DataFrame) -> int:
    """As many shards as the texts' size asks for; a task takes one after the other."""
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def repeats(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Every later occurrence of runs: rid, doc_id, words start..stop, and its source's rid, doc_id and start."""
    plain = pick(docs, "doc_id", "text").select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.col("doc_id").cast("bigint"), "text")
    shards = _shards(plain)

    def meet(table: pa.Table) -> pa.Table:
        return _meet(table, run_words)

    return _blocks(plain, run_words, shards).groupBy("shard").applyInArrow(meet, _REPEAT)


def matches(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Repeats extended both ways: (doc_id, start, stop) in words and the source, one row per diagonal run."""
    found = repeats(docs, run_words).distinct().withColumn("diagonal", F.col("start") - F.col("source_start"))
    line = Window.partitionBy("rid", "source_rid", "diagonal").orderBy("start")
    apart = (F.col("start") > F.coalesce(F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    numbered = found.withColumn("apart", apart).withColumn("island", F.sum("apart").over(line))
    return numbered.groupBy("rid", "doc_id", "source_doc_id", "source_rid", "diagonal", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("source_start").alias("source_start")
    ).drop("rid", "source_rid", "diagonal", "island")


def _cut_pieces(texts: pa.Array, gone: pa.Array) -> tuple[list, list, list]:
    out, n_gone, gone_words = [], [], []
    for text, drop in zip(texts, gone.to_pylist(), strict=True):
        whole = text.as_py()
        if not drop:
            out.append(whole)
            n_gone.append(0)
            gone_words.append(0)
            continue
        parts = pieces(whole or "")
        words = [k for k, p in enumerate(parts) if is_word(p)]
        flags = np.zeros(len(parts), dtype=bool)
        for interval in drop:
            flags[words[interval["start"]] : words[interval["stop"] - 1] + 1] = True
        kept = [p for p, flag in zip(parts, flags.tolist(), strict=True) if not flag]
        out.append("".join(kept) if any(map(is_word, kept)) else "")
        n_gone.append(int(flags.sum()))
        gone_words.append(sum(is_word(p) for p, flag in zip(parts, flags.tolist(), strict=True) if flag))
    return out, n_gone, gone_words


def _with_repeats(docs: DataFrame, run_words: int) -> tuple[Carried, DataFrame]:
    """The frame with a column `gone`, the intervals of its row that repeat earlier ones."""
    intervals = repeats(docs, run_words).groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    frame = Carried(docs)
    keyed = frame.df.withColumn("rid", row_key(frame.col("doc_id"), frame.col("text")))
    return frame, keyed.join(cut(intervals), "rid", "left")


def _rewrite(joined: DataFrame, carry: list[str], text: str) -> DataFrame:
    """Adds new_text, n_gone and gone_words."""
    fields = joined.select(*carry).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_gone, gone_words = _cut_pieces(batch.column(len(carry)), batch.column(len(carry) + 1))
            made = [pa.array(out, pa.string()), pa.array(n_gone, pa.int64()), pa.array(gone_words, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], [*carry, "new_text", "n_gone", "gone_words"])

    rows = joined.select(*carry, F.col(text).alias("old_text"), "gone")
    return rows.mapInArrow(run, f"{schema}, new_text string, n_gone bigint, gone_words bigint")


def dedup(docs: DataFrame, run_words: int = RUN_WORDS, length: str = "n_chars") -> DataFrame:
    """The rows with repeated runs cut out of `text` and, where there is such a column, `length` counted anew."""
    frame, joined = _with_repeats(docs, run_words)
    slot = frame.slot("text")
    others = [s for s in frame.slots if s != slot]
    done = _rewrite(joined, others, slot).withColumn(slot, F.col("new_text"))
    if length in frame.names:
        chars = frame.slot(length)
        done = done.withColumn(chars, F.when(F.col("n_gone") > 0, F.length("new_text").cast(frame.types[frame.names.index(length)].dataType)).otherwise(F.col(chars)))
    return frame.back(done)


def report(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_gone (pieces), gone_words and the remaining text of every row."""
    frame, joined = _with_repeats(docs, run_words)
    slot = frame.slot("doc_id")
    done = _rewrite(joined, [slot], frame.slot("text"))
    return done.select(F.col(slot).cast("bigint").alias("doc_id"), "n_gone", "gone_words", F.col("new_text").alias("text"))
