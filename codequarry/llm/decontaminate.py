"""Benchmark decontamination through suffix arrays over shards of the training texts.

A shard is what one task holds of the documents at a time, bounded by words. Its suffix array lists
the places whose suffixes can match the benchmark at all (their first words occur there in that
order), sorted by their words. Every benchmark suffix is then looked up by binary search, equal windows
once, all of them at once: the lower and upper ends of the suffixes that begin with its window give every
location. Hits are marked by place, and items are found once per document and set of items, so a window
that is frequent in the texts, in the benchmark or in both is never expanded into pairs of places.

The longest verbatim match at every location comes from the hit words alone: their suffixes and those of
the windows found are sorted together by doubling, and of the two benchmark suffixes next to a location's
one shares the most words with it. A match is reported where it doesn't merely continue the one before,
with one item and place that hold it; `items` lists every item with a window in the document.

The benchmark is read in blocks of bounded size, each sent to all tasks once; a document's hits in
several blocks are united by its row key. Documents are never shuffled to find matches.

Words: A-Z lower-cased, then runs of digits, letters a-z and everything beyond ASCII. An item of fewer
words than a window is one window by itself.

Defined results: null texts and items have no words, match nothing and are clean; a null item id is
written as an empty name; repeated items are each reported; repeated rows each get the same result;
texts longer than a shard are a shard of their own; with an empty benchmark every document is clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import Carried, pick, row_key
from codequarry.session import cut

WINDOW = 10
#: Words of the benchmark in one block, and of the documents in one shard.
BLOCK_WORDS = 2_000_000
SHARD_WORDS = 2_000_000
#: Names of items and matches in one batch of answers, but for the last document's.
BATCH_NAMES = 100_000

_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Suffixes:
    """The benchmark's words as numbers, and the suffixes that are looked up."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.ids: dict[bytes, int] = {}
        numbers, item_of, left = [], [], []
        for i, (_, text) in enumerate(items):
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            # A zero after every item keeps matches inside it.
            numbers += [*own, 0]
            item_of += [i] * (len(own) + 1)
            left += range(len(own), -1, -1)
        self.text = np.array([*numbers, *[0] * window], dtype=np.int64)
        self.item_at = np.array(item_of, dtype=np.int32)
        left_at = np.array(left, dtype=np.int32)
        size = (np.bincount(self.item_at, minlength=len(items))[self.item_at] - 1).astype(np.int32) if len(left) else left_at
        self.own_place = size - left_at
        # A place starts a window if the window fits, or if it starts an item shorter than one.
        starts = np.flatnonzero((left_at >= window) | ((left_at == size) & (size < window) & (size > 0)))
        length = np.minimum(left_at[starts], window)
        # Equal windows are looked up once. Short items differ from longer windows by the zeros that fill them up.
        spelled = [np.where(d < length, self.text[starts + d], 0).astype(np.int32) for d in range(window)]
        order = np.lexsort(spelled[::-1])
        new = np.ones(len(starts), dtype=bool)
        new[1:] = False
        for column in spelled:
            new[1:] |= column[order][1:] != column[order][:-1]
        heads = np.flatnonzero(new)
        self.start = starts[order][heads]
        self.length = length[order][heads].astype(np.int64)
        # All places of window i are places[first[i] : first[i + 1]], in order.
        self.places = starts[order]
        self.first = np.append(heads, len(starts))
        self._item_sets()
        # Which pairs of first words begin a window; items of one word count by it alone.
        base = len(self.ids) + 1
        self.base = base
        one = self.length == 1
        self.single = np.unique(self.text[self.start[one]])
        self.pairs = np.unique(self.text[self.start[~one]] * base + self.text[self.start[~one] + 1])

    def _item_sets(self) -> None:
        """Numbers the distinct sets of items that windows occur in, so that a document asks each set once."""
        item = self.item_at[self.places]
        self.sets = [np.array([i], dtype=np.int32) for i in range(len(self.names))]
        # Places of a window are in order, so a window of one item has that item first and last.
        self.set_of = item[self.first[:-1]].astype(np.int64)
        numbers: dict[bytes, int] = {}
        for i in np.flatnonzero(self.set_of != item[self.first[1:] - 1]).tolist():
            items = np.unique(item[self.first[i] : self.first[i + 1]])
            k = numbers.setdefault(items.tobytes(), len(self.sets))
            if k == len(self.sets):
                self.sets.append(items)
            self.set_of[i] = k

    def number(self, tokens: list[bytes]) -> list[int]:
        get = self.ids.get
        return [get(w, 0) for w in tokens]


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def suffix_array(text: np.ndarray, suffixes: Suffixes) -> np.ndarray:
    """Places of the shard that can begin a match, sorted by their next `window` words.

    `text` ends with `window` zeros; zero stands for every word the benchmark doesn't know.
    """
    body = text[: -suffixes.window]
    after = text[1 : len(body) + 1]
    can = (body > 0) & (_member(body * suffixes.base + after, suffixes.pairs) | _member(body, suffixes.single))
    places = np.flatnonzero(can)
    if not len(places):
        return places
    # Least significant word first; each sort is stable, so the places end up in order of all words.
    keys = [text[places + d] for d in range(suffixes.window - 1, -1, -1)]
    return places[np.lexsort(keys)]


def _compare(text: np.ndarray, places: np.ndarray, query: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sign of suffix against query over the query's first `length` words."""
    sign = np.zeros(len(places), dtype=np.int8)
    open_ = np.arange(len(places))
    for d in range(int(length.max()) if len(length) else 0):
        open_ = open_[length[open_] > d]
        a, b = text[places[open_] + d], query[starts[open_] + d]
        differs = a != b
        sign[open_[differs]] = np.where(a[differs] < b[differs], -1, 1)
        open_ = open_[~differs]
        if not len(open_):
            break
    return sign


def locate(text: np.ndarray, array: np.ndarray, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 entry of the suffix array that begin with each looked-up window."""
    n = len(suffixes.start)
    ends = []
    for upper in (False, True):
        low, high = np.zeros(n, dtype=np.int64), np.full(n, len(array), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            sign = _compare(text, array[middle], suffixes.text, suffixes.start[open_], suffixes.length[open_])
            right = sign <= 0 if upper else sign < 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        ends.append(low)
    return ends[0], ends[1]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range every number of the ranges first .. first + count belongs to, and the numbers."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _covered(n: int, places: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of n words lie in an interval, by counting begins and ends."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + length, -1)
    return np.cumsum(change[:-1]) > 0


def _compact(text: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The covered words, each run followed by a zero, and where every word of the text went."""
    ends = np.zeros(len(covered), dtype=bool)
    ends[:-1] = covered[:-1] & ~covered[1:]
    ends[-1:] = covered[-1:]
    moved = np.cumsum(covered) - 1 + np.cumsum(ends) - ends
    out = np.zeros(int(covered.sum() + ends.sum()), dtype=np.int64)
    out[moved[covered]] = text[: len(covered)][covered]
    return out, moved


def _longest(text: np.ndarray, places: np.ndarray, own: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places of one text: the start in the other that shares most words with them, and how many. Zeros match nothing."""
    joint = np.concatenate([text, own])
    blank = np.flatnonzero(joint == 0)
    joint[blank] = joint.max(initial=0) + 1 + np.arange(len(blank))
    rank = np.unique(joint, return_inverse=True)[1]
    runs = np.diff(np.flatnonzero(np.append(True, own == 0)))
    levels = [rank.astype(np.int32)]
    step = 1
    while step <= runs.max(initial=0) and rank.max(initial=0) + 1 < len(joint):
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1]
        levels.append(rank.astype(np.int32))
        step *= 2
    begin = np.sort(starts) + len(text)
    order = np.lexsort((begin, rank[begin]))
    begin = begin[order]
    at = np.searchsorted(rank[begin], rank[places])
    best, most = np.zeros(len(places), dtype=np.int64), np.full(len(places), -1, dtype=np.int64)
    for near in (at - 1, at):
        there = begin[np.clip(near, 0, len(begin) - 1)]
        shared = np.zeros(len(places), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            # Both stop at a blank of their own at the latest, so neither runs over its end.
            shared += np.where(levels[k][places + shared] == levels[k][there + shared], 1 << k, 0)
        better = shared > most
        best[better], most[better] = there[better] - len(text), shared[better]
    return best, most


def matches(text: np.ndarray, doc_of: np.ndarray, suffixes: Suffixes) -> tuple[np.ndarray, ...]:
    """Every longest verbatim match of a shard (document, item, place in the shard, place in the item, words), then
    which of its words are hit, and which documents hold windows of which set of items.

    Zeros separate documents, so no window runs from one into the next. Work and memory grow with the
    words: a place begins at most one window of full length and one short item of each length.
    """
    array = suffix_array(text, suffixes)
    first, stop = locate(text, array, suffixes)
    window, entry = _spread(first, stop - first)
    place, length = array[entry], suffixes.length[window]
    hit = _covered(len(doc_of), place, length)
    met = np.unique(np.column_stack([doc_of[place], suffixes.set_of[window]]), axis=0)
    full = length == suffixes.window
    # Windows of full length: the longest match at their place, unless it is the last place's match going on.
    at = np.sort(place[full])
    found = np.unique(window[full])
    if len(at):
        _, own = _spread(suffixes.first[found], suffixes.first[found + 1] - suffixes.first[found])
        own = suffixes.places[own]
        size = suffixes.window
        doc_words, moved = _compact(text, _covered(len(doc_of), at, size))
        own_words, own_moved = _compact(suffixes.text, _covered(len(suffixes.item_at), own, size))
        best, most = _longest(doc_words, moved[at], own_words, own_moved[own])
        back = np.zeros(len(own_words), dtype=np.int64)
        back[own_moved[own]] = own
        best = back[best]
    else:
        best = most = at
    head = np.ones(len(at), dtype=bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (most[1:] != most[:-1] - 1)
    # Short items are one window each; the first of equal ones names the match.
    short = ~full
    single = suffixes.places[suffixes.first[window[short]]]
    at, best, most = np.append(at[head], place[short]), np.append(best[head], single), np.append(most[head], length[short])
    return doc_of[at], suffixes.item_at[best], at, suffixes.own_place[best], most, hit, met


SCHEMA = "rid bigint, doc_id bigint, n_words bigint, hits array<struct<start:bigint,stop:bigint>>, found array<struct<item:string,start:bigint,item_start:bigint,words:bigint>>, items array<string>"
NAMES = ["rid", "doc_id", "n_words", "hits", "found", "items"]
TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
    pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())])), pa.list_(pa.string()),
]


def _scan(plain: DataFrame, suffixes, shard_words: int) -> DataFrame:
    """One row per document row: its words, united hit intervals and longest matches, against one block."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held, size = [], 0
        for batch in batches:
            for rid, doc_id, text in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2), strict=True):
                tokens = words(text.as_py())
                held.append((rid, doc_id, len(tokens), suffixes.value.number(tokens)))
                size += len(tokens)
                if size >= shard_words:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = suffixes.value
        for shard in shards(batches):
            # A zero after every document keeps windows inside it.
            begins = np.cumsum([0, *[row[2] + 1 for row in shard]])
            text = np.zeros(begins[-1] + own.window, dtype=np.int64)
            for row, begin in zip(shard, begins, strict=False):
                text[begin : begin + row[2]] = row[3]
            doc_of = np.repeat(np.arange(len(shard)), np.diff(begins))
            doc, item, place, at, n, hit, met = matches(text, doc_of, own)
            hits: list[list[dict]] = [[] for _ in shard]
            found: list[list[dict]] = [[] for _ in shard]
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for d, p, q in zip(doc_of[start].tolist(), (start - begins[doc_of[start]]).tolist(), (stop - begins[doc_of[start]]).tolist(), strict=True):
                hits[d].append({"start": p, "stop": q})
            order = np.lexsort((n, at, item, place))
            for d, i, p, q, k in zip(*[c[order].tolist() for c in (doc, item, place - begins[doc], at, n)], strict=True):
                found[d].append({"item": own.names[i], "start": p, "item_start": q, "words": k})
            # Frequent windows of many items make long lists of names: few of them are held at once.
            rows, held = [], 0
            for d, (rid, doc_id, n_words, _) in enumerate(shard):
                sets = met[np.searchsorted(met[:, 0], d) : np.searchsorted(met[:, 0], d, "right"), 1]
                names = [own.names[i] for i in np.unique(np.concatenate([own.sets[k] for k in sets.tolist()])).tolist()] if len(sets) else []
                rows.append((rid, doc_id, n_words, hits[d], found[d], names))
                held += len(names) + len(found[d])
                if held >= BATCH_NAMES or len(rows) >= BATCH_NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES, strict=True)], NAMES)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES, strict=True)], NAMES)

    return plain.mapInArrow(run, SCHEMA)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of bounded size, partition by partition; one block is in memory at a time."""
    plain = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    held, size = [], 0
    for row in plain.toLocalIterator():
        held.append((row["item"], row["text"]))
        size += len(row["text"] or "") // 2 + 1
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """rid, doc_id, n_words, hits (disjoint word intervals), found (longest matches with a place) and items (all that occur) of every row."""
    plain = pick(docs, "doc_id", "text")
    plain = plain.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.col("doc_id").cast("bigint"), "text")
    context = docs.sparkSession.sparkContext
    scans = [_scan(plain, context.broadcast(Suffixes(block)), shard_words) for block in _blocks(benchmark, block_words)]
    if not scans:
        scans = [_scan(plain, context.broadcast(Suffixes([])), shard_words)]
    if len(scans) == 1:
        return scans[0]
    return _united(plain, scans)


def _united(plain: DataFrame, scans: list[DataFrame]) -> DataFrame:
    """Several blocks' results for the same rows: matches together, intervals merged where they meet."""
    every = scans[0]
    for more in scans[1:]:
        every = every.unionByName(more)
    # Equal rows gave equal results in every block, so one row per key and block is enough.
    single = every.groupBy("rid").agg(
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"),
        F.flatten(F.collect_list("items")).alias("items"),
    )

    def meet(done: Column, hit: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], hit["stop"]).alias("stop"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (hit["start"] <= F.try_element_at(done, F.lit(-1))["stop"]), joined).otherwise(F.concat(done, F.array(hit)))

    nothing = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    merged = single.withColumn("hits", F.aggregate(F.array_sort("hits"), nothing, meet))
    return plain.select("rid", "doc_id").join(merged, "rid").select("rid", "doc_id", "n_words", "hits", "found", "items")


def report(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_hit, the items found, their longest match, and whether the document is contaminated."""
    found = overlaps(docs, benchmark, **sizes)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["stop"] - h["start"])
    items = F.array_sort(F.array_distinct("items"))
    longest = F.coalesce(F.array_max(F.transform("found", lambda m: m["words"])), F.lit(0).cast("bigint"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items"), longest.alias("longest"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """The rows that share no window with the benchmark, with all their columns."""
    dirty = cut(overlaps(docs, benchmark, **sizes).filter(F.size("hits") > 0).select("rid").distinct())
    frame = Carried(docs)
    keyed = frame.df.withColumn("rid", row_key(frame.col("doc_id"), frame.col("text")))
    return frame.back(keyed.join(dirty, "rid", "left_anti"))
