"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Words lie in padded matrices of code points, once aligned at their first and once at their last
character. Blocks of rows are compared with blocks of rows: two words differ by exactly one inserted,
deleted or replaced code point if their common prefix and common suffix together reach the length of
the longer one less one.

Only words that can be one edit apart meet. Let n be the length of the longer word and p the common
prefix: the edit stands at p. If p lies in an interval [lo, hi) of the n places, the first lo and the
last n - hi code points are equal, so these are the key. Every word is dealt for its own length and the
next one, under both halves of the places. A key that many words share is dealt again under both halves
of its interval, until few share it or the interval is one place, where only the alphabet is left. A
pair counts under the one interval that holds its p, so no pair counts twice and none is lost, however
many words begin alike.

A task returns at most one row per word and key: the number of its near words and the best one. Words
are counted in each task before they are shuffled.

Defined results: runs of letters (A-Z, a-z, U+00C0 to U+00FF) are words, only A-Z fold; null texts have
none; a row without an id loses no letters to the deletion rule; repeated rows count as often as they
stand; a word without near words has null form and is its own root; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import pick
from codequarry.session import cut

SHORTEST = 6
OCCURRENCES = 5
#: A form occurs at least so many times as often as its variant.
DOMINANCE = 5
#: A run in a document loses a letter if this number divides the checksum of both.
EVERY = 199
#: Keys with more words are dealt again.
CROWD = 1024
#: Rows of a tile; groups up to SMALL rows are compared in bulk, along their diagonals.
TILE = 256
SMALL = 48
#: Distinct words that a task gathers before it passes them on.
GATHER = 400_000
CHUNK = 1 << 16
#: Letters U+00C0 to U+00FF are the byte C3 and one more.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def words_of(doc_id: int | None, text: str | None, shortest: int = SHORTEST, every: int = EVERY) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one whole text, after the deletion rule."""
    base = None if doc_id is None else crc32(b"%d:" % doc_id)
    # Folding bytes touches A-Z only.
    for run, n in Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").lower())).items():
        # Code points are never more than bytes.
        if len(run) < shortest:
            continue
        word = run.decode()
        checksum = 1 if base is None else crc32(run, base)
        if checksum % every == 0:
            at = checksum % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= shortest:
            yield word, n


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, occurrences: int = OCCURRENCES, every: int = EVERY) -> DataFrame:
    """word and n of all words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(gathered.keys(), pa.string()), pa.array(gathered.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in words_of(doc_id.as_py(), text.as_py(), shortest, every):
                    gathered[word] += n
                if len(gathered) >= GATHER:
                    yield passed_on()
                    gathered.clear()
        yield passed_on()

    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return plain.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _key(lo: Column, hi: Column) -> Column:
    """The interval [lo, hi) of the places of the longer word, and what a word has outside of it."""
    before = F.substring("word", F.lit(1), lo)
    after = F.substring("word", F.length("word") - (F.col("long") - hi) + 1, F.col("long") - hi)
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.xxhash64("long", lo, hi, before, F.lit("|"), after).alias("key"))


def _halves(rows: DataFrame) -> DataFrame:
    """Every row under both halves of its interval."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.explode(F.array(_key(F.col("lo"), middle), _key(middle, F.col("hi")))).alias("k")
    return rows.select("word", "n", "long", both).select("word", "n", "long", "k.lo", "k.hi", "k.key")


def _aligned(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and the padded code-point matrices aligned left and (mirrored) aligned right."""
    left = words.astype(f"U{width}").view(np.uint32).reshape(len(words), width)
    lengths = (left != 0).sum(axis=1)
    places = lengths[:, None] - 1 - np.arange(width)
    right = np.where(places >= 0, np.take_along_axis(left, np.maximum(places, 0), axis=1), 0)
    return lengths, left, right


def _run_length(equal: np.ndarray) -> np.ndarray:
    """Leading True values along the last axis."""
    first = equal.argmin(axis=-1)
    return np.where(equal.all(axis=-1), equal.shape[-1], first)


def single_edits(words: np.ndarray, group: np.ndarray, long: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs, one edit apart within [lo, hi), of words that are sorted by group; the longer word of a pair has `long` code points."""
    lengths, left, right = _aligned(words, long)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    found_x, found_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        """The pairs that stand the test on whole words."""
        real = (lengths[x] == long) | (lengths[y] == long)
        x, y = x[real], y[real]
        prefix, suffix = _run_length(left[x] == left[y]), _run_length(right[x] == right[y])
        real = (prefix + suffix >= long - 1) & (prefix >= lo[x]) & (prefix < hi[x])
        found_x.append(x[real])
        found_y.append(y[real])

    # Small groups, all at once: every row with the one s rows further down.
    end = np.repeat(starts + sizes, sizes)
    rows = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for s in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
        rows = rows[rows + s < end[rows]]
        for at in range(0, len(rows), CHUNK):
            keep(rows[at : at + CHUNK], rows[at : at + CHUNK] + s)
    # Large groups: tiles over the columns of their interval; what is equal there is tested on whole words.
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        stop, width = start + size, int(hi[start] - lo[start])
        ahead = np.ascontiguousarray(left[start:stop, lo[start] : hi[start]])
        behind = np.ascontiguousarray(right[start:stop, long - hi[start] : long - lo[start]])
        for a in range(0, size, TILE):
            for b in range(a, size, TILE):
                prefix = _run_length(ahead[a : a + TILE, None, :] == ahead[None, b : b + TILE, :])
                suffix = _run_length(behind[a : a + TILE, None, :] == behind[None, b : b + TILE, :])
                x, y = np.nonzero(prefix + suffix >= width - 1)
                x, y = x + a + start, y + b + start
                keep(x[x < y], y[x < y])
    return np.concatenate(found_x), np.concatenate(found_y)


def _search(dealt: DataFrame) -> DataFrame:
    """Per word and key: the number of near words, and the best of them."""

    def judged(rows: pa.Table) -> pa.RecordBatch:
        words = rows.column("word").to_numpy().astype(object)
        n, long = rows.column("n").to_numpy(), rows.column("long")[0].as_py()
        words = np.array(words.tolist(), dtype=f"U{long}")
        x, y = single_edits(words, rows.column("key").to_numpy(), long, rows.column("lo").to_numpy(), rows.column("hi").to_numpy())
        x, y = np.concatenate([x, y]), np.concatenate([y, x])
        order = np.lexsort((words, -n))
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        best = np.full(len(n), len(n))
        np.minimum.at(best, x, place[y])
        count = np.bincount(x, minlength=len(n))
        has = np.flatnonzero(count)
        of = order[best[has]]
        columns = [pa.array(words[has].tolist(), pa.string()), pa.array(count[has], pa.int64()), pa.array(n[of]), pa.array(words[of].tolist(), pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            length, key = rows.column("long").to_numpy(), rows.column("key").to_numpy()
            # Whole keys only, and each length on its own; the last key may go on in the next batch.
            last = int(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (length[1:] != length[:-1])))[-1])
            cuts = np.flatnonzero(np.append(True, length[1 : last + 1] != length[:last])).tolist()
            for start, stop in zip(cuts, [*cuts[1:], last], strict=True):
                if stop > start:
                    yield judged(rows.slice(start, stop - start))
            held = rows.slice(last)
        if held is not None:
            yield judged(held)

    arranged = dealt.repartition("long", "key").sortWithinPartitions("long", "key", F.length("word").desc(), "word")
    return arranged.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n_near, best (near word of largest n; of equal ones the first in code-point order) and best_n of a table (word, n) of distinct words."""
    for_lengths = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("long")
    rows = words.select("word", "n", for_lengths).withColumns({"lo": F.lit(0), "hi": F.col("long")})
    dealt, found = _halves(rows), None
    while True:
        crowds = cut(dealt.filter("hi - lo > 1").groupBy("long", "key").count().filter(F.col("count") > crowd).select("long", "key"))
        crowded = not crowds.isEmpty()
        here = _search(dealt.join(crowds, ["long", "key"], "left_anti") if crowded else dealt)
        found = here if found is None else found.union(here)
        if not crowded:
            break
        dealt = cut(_halves(dealt.join(crowds, ["long", "key"], "left_semi")))
    # The largest n comes first as its smallest negative.
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last word that a table (word, form) of chains without circles leads to. Steps double every round."""
    current = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if current.join(ahead, "root", "left_semi").isEmpty():
            return current
        current = cut(current.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def group(words: DataFrame, dominance: int = DOMINANCE, crowd: int = CROWD) -> DataFrame:
    """word, n, n_near, form, form_n and root of a table (word, n) of distinct words."""
    near = near_words(words, crowd)
    with_best = words.join(near, "word", "left")
    wins = F.col("best_n") >= dominance * F.col("n")
    named = cut(with_best.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(wins, F.col("best")).alias("form"), F.when(wins, F.col("best_n")).alias("form_n"),
    ))
    rooted = roots(named.filter("form IS NOT NULL").select("word", "form"))
    return named.join(rooted, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, shortest: int = SHORTEST, occurrences: int = OCCURRENCES, every: int = EVERY) -> DataFrame:
    """The words of all documents with their forms."""
    return group(cut(vocabulary(docs, shortest, occurrences, every)))
