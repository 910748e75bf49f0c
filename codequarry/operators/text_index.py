"""The stored text index: postings with positions, places, statistics, runs of word characters and their grams.

Five tables, of which four belong to files and are replaced with them (`sources.store`):

- postings: one row per chunk and term with its count and positions, sorted by term within each
  partition, so a search reads the row groups of its terms;
- places: path, lines and hash of every chunk, without its text;
- text_stats: chunks and tokens per file; the corpus statistics are their sums, so a refresh moves them by
  the files it touched;
- runs: the distinct runs of word characters per chunk, sorted by run;
- run_grams: the 1- to 3-grams of every run that ever was. It only grows; a run that no chunk holds any
  more finds no chunk. The empty gram lists every run once.

Searches read these tables, never a text. The tables make three parts, each built when a search first asks
for it. A part shuffles texts once, to the tasks that write their buckets; what follows from a text is derived there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators.lookup import all_grams
from codequarry.sources.store import Derive, FactStore

PLACE = ["project_id", "path", "chunk_id", "start_line"]
ORDERS = {"postings": ["term", "chunk_id"], "runs": ["run"], "run_grams": ["gram", "word"], "name_grams": ["gram", "word"]}


#: Tables by what asks for them: phrases, where chunks stand, literals.
PARTS = {"terms": ("text_stats", "postings"), "places": ("places",), "literals": ("runs",)}
#: Rows that leave the helper at once.
SLICE_ROWS = 65_536


class TextIndex:
    """The tables of an index, opened when they are first asked for; `store_of` names the store of a part."""

    def __init__(self, store_of: Callable[[str], FactStore]):
        self._store_of = store_of

    @cached_property
    def postings(self) -> DataFrame:
        return self._store_of("terms").read("postings")

    @cached_property
    def stats(self) -> DataFrame:
        return self._store_of("terms").read("text_stats")

    @cached_property
    def places(self) -> DataFrame:
        return self._store_of("places").read("places")

    @cached_property
    def runs(self) -> DataFrame:
        return self._store_of("literals").read("runs")

    @cached_property
    def grams(self) -> DataFrame:
        return self._store_of("literals").whole("run_grams")


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Chunks with their tokens to one row per chunk and term, with its count and positions."""
    tokens = batch.column(len(PLACE))
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    key = row * max(1, len(words.dictionary)) + codes
    # Stable, so the positions of a term stay in order.
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)[: len(order)])
    bounds = np.append(heads, len(order)).astype(np.int32)
    first = order[heads]
    own = pa.array(row[first])
    columns = [batch.column(i).take(own) for i in range(len(PLACE))]
    columns += [pa.array(sizes[row[first]].astype(np.int32)), words.dictionary.take(pa.array(codes[first]))]
    columns += [pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(pos[order]))]
    return pa.RecordBatch.from_arrays(columns, [*PLACE, "dl", "term", "tf", "positions"])


def postings_of(chunks: DataFrame) -> DataFrame:
    """chunks(project_id, path, chunk_id, start_line, content) to their postings, chunk by chunk and without a shuffle."""
    tokens = chunks.select(*PLACE, tx.index_tokens(F.col("content")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _counted(batch)
            for at in range(0, rows.num_rows, SLICE_ROWS):
                yield rows.slice(at, SLICE_ROWS)

    place = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema.fields[: len(PLACE)])
    return tokens.mapInArrow(run, f"{place}, dl int, term string, tf bigint, positions array<int>")


def merged(postings: DataFrame) -> DataFrame:
    """Postings of chunks that occur several times, added up."""
    # A chunk is a bounded number of lines, and so is the list of a term's places in it.
    positions = F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
    return postings.groupBy(*PLACE, "dl", "term").agg(F.sum("tf").alias("tf"), positions)


def places_of(chunks: DataFrame) -> DataFrame:
    return chunks.select(*PLACE, *[name for name in ("end_line", "source_hash") if name in chunks.columns])


def stats_of(chunks: DataFrame) -> DataFrame:
    dl = F.size(tx.index_tokens(F.col("content")))
    return chunks.groupBy("project_id", "path").agg(F.count("*").alias("chunks"), F.sum(dl.cast("bigint")).alias("tokens"))


def runs_of(chunks: DataFrame) -> DataFrame:
    runs = F.array_distinct(F.regexp_extract_all(tx.ascii_lower(F.col("content")), F.lit(tx.WORD_RUN), 0))
    return chunks.select(*PLACE, F.explode(runs).alias("run"))


def grams_of(words: DataFrame) -> DataFrame:
    """(gram, word) of a table of distinct words, the empty gram included."""
    return words.select(F.explode(F.concat(F.array(F.lit("")), all_grams(F.col("word")))).alias("gram"), "word")


TABLES: dict[str, Derive] = {"postings": postings_of, "places": places_of, "text_stats": stats_of, "runs": runs_of}


def derived(chunked: Callable[[DataFrame], DataFrame]) -> dict[str, Derive]:
    """How the tables follow from files, given how files are cut into chunks."""
    return {table: lambda files, rows_of=rows_of: rows_of(chunked(files)) for table, rows_of in TABLES.items()}


def _learn(store: FactStore, words: DataFrame) -> None:
    """Store the grams of distinct words. They are made where they are written, as a word has as many grams as letters, three times."""
    store.extend("run_grams", grams_of(words.repartition(max(store.parts, 16 * store.buckets), "word")), placed=True)


def learn_runs(store: FactStore) -> None:
    """Add the grams of runs the index hasn't met."""
    runs = store.read("runs").select(F.col("run").alias("word")).distinct()
    known = store.whole("run_grams").filter("gram = ''").select("word")
    _learn(store, runs.join(known, "word", "left_anti"))


def build(store: FactStore, chunks: DataFrame, parts: tuple[str, ...] = tuple(PARTS)) -> None:
    """The whole index of chunks, or parts of it; readers see it from the moment it is published."""
    for table in (table for part in parts for table in PARTS[part]):
        if table == "postings" and not chunks.groupBy("project_id", "path", "chunk_id").count().filter("count > 1").isEmpty():
            store.create(table, merged(postings_of(chunks)))
        elif table in ("postings", "runs"):
            store.create(table, TABLES[table](store.placed(chunks.select(*PLACE, "content"))), placed=True)
        else:
            store.create(table, TABLES[table](chunks))
    if "literals" in parts:
        _learn(store, store.read("runs").select(F.col("run").alias("word")).distinct())
    store.publish()


def opened(store: FactStore) -> TextIndex:
    return TextIndex(lambda part: store)
