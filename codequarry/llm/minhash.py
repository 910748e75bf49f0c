"""b-bit MinHash near-duplicates: packed low bits of minima, band candidates, collision-corrected estimates.

A text is the set of its distinct five-word shingles, as 64-bit hashes. 160 hash functions give 160
minima. Five successive minima make a band key; the lowest four bits of each minimum are packed into a
signature of 80 bytes. Texts that share a band key are candidates. The share of equal four-bit fields,
found by bit counts, overstates the similarity by chance collisions; (share - 1/16) / (1 - 1/16)
corrects that. Candidates whose estimate lies more than six standard errors below the limit, or whose
set sizes alone keep them under it, go; every link among the rest is confirmed on the full sets.

Only distinct sets are compared: copies share one digest of 128 bits and cost one row per task.

 1. Under every band key the estimates join candidates to clumps; a task returns a spanning forest of a
    key's members, never their pairs. Linked texts lie in one clump.
 2. Every member of a clump meets the others once, with its full set, which is inverted within the task.
    What is connected already isn't looked at again; a task returns a spanning forest of the confirmed links.

Crowded keys and clumps are dealt in parts of bounded number and size; every two parts meet in a tile.

Two texts of similarity s share no band with probability (1 - s^5)^32: 7e-9 at 0.85, less above. The
estimate rejects a pair of similarity 0.85 with a probability of about 2e-8. Nothing else is lost.

Defined results: words part at the six ASCII white-space characters, A-Z count as a-z; a text of one
to four words is one shingle of its own; null and blank texts have no shingles, are linked with nothing
and are their own component; repeated rows share a set and so a component; rows with a null id are
linked like any other, and a component without any id has the id null; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import pick, row_key
from codequarry.llm.components import components
from codequarry.session import cut

SHINGLE = 5
#: Links need 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
BANDS = 32
ROWS = 5
HASHES = BANDS * ROWS
BITS = 4
FIELDS = 64 // BITS
WORDS = HASHES // FIELDS
#: Six standard errors of the estimate at the limit, sqrt(p (1 - p) / HASHES) / (1 - 2^-BITS) with p the share of equal fields.
LEAST = 0.65
#: Members, and shingles of full sets, that a part of a crowded key or clump holds on average.
TILE = 2048
TILE_SHINGLES = 1 << 20
CACHE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = np.array([xxhash.xxh64_intdigest(b"multiply %d" % i) | 1 for i in range(HASHES)], dtype=np.uint64)[:, None]
_ADD = np.array([xxhash.xxh64_intdigest(b"add %d" % i) for i in range(HASHES)], dtype=np.uint64)[:, None]


class _WordHashes(dict):
    """Hashes of words, each computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values *= _ODD
    values ^= values >> np.uint64(29)
    return values


def shingles(text: str | None, hashes: _WordHashes) -> np.ndarray:
    """The distinct shingle hashes of one whole text, sorted."""
    # Folding bytes touches A-Z only; splitting bytes uses exactly the six white-space bytes of the word rule.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    of = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(of))
    # A shorter sequence starts from its length, so it never equals a full shingle by its words.
    rolled = of[: len(of) - size + 1] + np.uint64(SHINGLE - size)
    for i in range(1, size):
        rolled = _mix(rolled) + of[i : len(of) - size + 1 + i]
    return np.unique(_mix(_mix(rolled)))


def minima(distinct: np.ndarray) -> np.ndarray:
    """The 32-bit minimum of every hash function over a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(distinct), 4096):
        np.minimum(least, (distinct[None, at : at + 4096] * _MULTIPLY + _ADD).min(axis=1), out=least)
    return least >> np.uint64(32)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of all minima, packed into 64-bit words."""
    low = (least & np.uint64((1 << BITS) - 1)).reshape(WORDS, FIELDS)
    return np.bitwise_or.reduce(low << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, which takes in the band's number."""
    bands = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key) + bands[:, i]
    return _mix(_mix(key))


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Collision-corrected similarities of signatures along the last axis, by bit counts."""
    apart = left ^ right
    apart |= apart >> np.uint64(1)
    apart |= apart >> np.uint64(2)
    apart &= np.uint64(0x1111111111111111)
    share = 1 - np.bitwise_count(apart).sum(axis=-1, dtype=np.int64) / HASHES
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def near_enough(similarity: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    return (similarity >= LEAST) & (100 * np.minimum(n_left, n_right) >= SIMILARITY * np.maximum(n_left, n_right))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, rid, n (set size), digest (of the set; null if empty), sig and bands of every row."""
    plain = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            n, digests, sigs, bands = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), hashes)
                least = minima(found)
                n.append(len(found))
                digests.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                sigs.append(packed(least).tobytes() if len(found) else None)
                bands.append(band_keys(least).view(np.int64) if len(found) else None)
            columns = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "rid", "n", "digest", "sig", "bands"])

    keyed = plain.select(F.col("doc_id").cast("bigint"), row_key(F.col("doc_id"), F.col("text")).alias("rid"), "text")
    return keyed.mapInArrow(run, "doc_id bigint, rid bigint, n bigint, digest binary, sig binary, bands array<bigint>")


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the labels of a[i] and b[i] have become one for all i: the smaller one."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, each with where its groups begin and end; rows come sorted by the names."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = [rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names]
        starts = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in keys])))
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts
        # The last group may go on in the next batch.
        held = rows.slice(int(starts[-1]))
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _in_tiles(rows: DataFrame, key: str) -> DataFrame:
    """Rows with `parts`, dealt to all pairs (lo, hi) of parts of their key that take in their own part."""
    placed = rows.withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("lo"), F.greatest("part", j).alias("hi")))
    dealt = placed.withColumn("t", F.explode(pairs)).withColumns({"lo": F.col("t.lo"), "hi": F.col("t.hi")}).drop("t", "parts")
    return dealt.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def _sides(rows: pa.Table, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of both parts of one tile; the same rows twice where a part meets itself."""
    part = rows.column("part").to_numpy()[start:stop]
    lo, hi = rows.column("lo")[start].as_py(), rows.column("hi")[start].as_py()
    return start + np.flatnonzero(part == lo), start + np.flatnonzero(part == hi)


def candidate_labels(sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after all promising pairs of left[i] and right[j] have been joined; tiles are compared in strips."""
    strip = max(1, (1 << 20) // (WORDS * max(1, len(right))))
    for at in range(0, len(left), strip):
        x, y = np.nonzero(label[left[at : at + strip]][:, None] != label[right][None, :])
        if len(x):
            x, y = left[at : at + strip][x], right[y]
            keep = near_enough(estimates(sig[x], sig[y]), n[x], n[y])
            label = _merged(label, x[keep], y[keep])
    return label


def _candidates(members: DataFrame) -> DataFrame:
    """(a, b) per key a spanning forest of its promising pairs, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, ["key", "lo", "hi"]):
            sig, n, label = _matrix(rows.column("sig")), rows.column("n").to_numpy(), np.arange(rows.num_rows)
            # Groups of two are most of all: one comparison each, all at once.
            two = starts[:-1][np.diff(starts) == 2]
            close = two[near_enough(estimates(sig[two], sig[two + 1]), n[two], n[two + 1])]
            label[close + 1] = close
            for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if stop - start > 2:
                    own = candidate_labels(sig[start:stop], n[start:stop], *(side - start for side in _sides(rows, start, stop)), np.arange(stop - start))
                    label[start:stop] = start + own
            other = np.flatnonzero(label != np.arange(len(label)))
            digest = rows.column("digest").combine_chunks()
            yield pa.RecordBatch.from_arrays([digest.take(pa.array(label[other])), digest.take(pa.array(other))], ["a", "b"])

    return members.mapInArrow(run, "a binary, b binary").distinct()


def confirmed_forest(sets: list[np.ndarray], sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links, confirmed on full sets, that connect what all links between left[i] and right[j] connect.

    The sets of the right side are inverted once; a set of the left side then counts its shared members
    with all of them at a time, unless everything promising is connected with it already.
    """
    n = np.array([len(one) for one in sets])
    # A part may have no members.
    held = np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in right.tolist()]])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], np.repeat(np.arange(len(right)), n[right])[order]
    label, found_x, found_y = np.arange(len(sets)), [], []
    for x in left.tolist():
        apart = np.flatnonzero(label[right] != label[x])
        apart = apart[near_enough(estimates(sig[x], sig[right[apart]]), n[x], n[right[apart]])]
        if not len(apart):
            continue
        first, stop = np.searchsorted(held, sets[x], "left"), np.searchsorted(held, sets[x], "right")
        sizes = stop - first
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        shared = np.bincount(owner[at], minlength=len(right))[apart]
        linked = right[apart[100 * shared >= SIMILARITY * (n[x] + n[right[apart]] - shared)]]
        _, once = np.unique(label[linked], return_index=True)
        linked = linked[once]
        found_x += [x] * len(linked)
        found_y += linked.tolist()
        label = _merged(label, np.full(len(linked), x), linked)
    return np.array(found_x, dtype=np.int64), np.array(found_y, dtype=np.int64)


def _with_sets(docs: DataFrame, clumped: DataFrame) -> DataFrame:
    """Rows of clumped (rid, digest, sig, clump, parts) with their full sets, as bytes."""
    keyed = pick(docs, "doc_id", "text").select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            found = [shingles(text.as_py(), hashes).tobytes() for text in batch.column("text")]
            # Row keys have 64 bits: a text of another set with the same one isn't meant.
            same = [xxhash.xxh128_digest(one) == digest for one, digest in zip(found, batch.column("digest").to_pylist(), strict=True)]
            kept = [batch.column(c) for c in ("clump", "parts", "digest", "sig")]
            whole = pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], ["clump", "parts", "digest", "sig", "members"])
            yield whole.filter(pa.array(same, pa.bool_()))

    return keyed.join(clumped.select("rid", "digest", "sig", "clump", "parts"), "rid").mapInArrow(run, "clump binary, parts int, digest binary, sig binary, members binary")


def _confirmed(tiles: DataFrame) -> DataFrame:
    """(a, b) confirmed links of every tile of every clump, a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, ["clump", "lo", "hi"]):
            digest, members = rows.column("digest").combine_chunks(), rows.column("members").combine_chunks()
            sig = _matrix(rows.column("sig"))
            found_a, found_b = [], []
            for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                sets = [np.frombuffer(members[i].as_buffer(), np.uint64) for i in range(start, stop)]
                a, b = confirmed_forest(sets, sig[start:stop], *(side - start for side in _sides(rows, start, stop)))
                found_a.append(a + start)
                found_b.append(b + start)
            yield pa.RecordBatch.from_arrays([digest.take(pa.array(np.concatenate(side))) for side in (found_a, found_b)], ["a", "b"])

    return tiles.mapInArrow(run, "a binary, b binary")


def links(docs: DataFrame, printed: DataFrame, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(a, b) confirmed links between digests of sets; they connect whatever all links connect."""
    nodes = cut(printed.filter("digest IS NOT NULL").select("digest", "rid", "n", "sig", "bands").dropDuplicates(["digest"]))
    dealt = nodes.select("digest", F.explode("bands").alias("key"))
    keys = dealt.groupBy("key").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"), F.count("*").alias("size")).filter("size > 1")
    members = dealt.join(keys.select("key", "parts"), "key").join(nodes.select("digest", "n", "sig"), "digest")
    clumps = cut(components(_candidates(_in_tiles(members, "key"))).select(F.col("node").alias("digest"), F.col("root").alias("clump")))
    named = clumps.join(nodes.select("digest", "rid", "n", "sig"), "digest")
    sizes = named.groupBy("clump").agg(F.ceil(F.greatest(F.count("*") / F.lit(tile), F.sum("n") / F.lit(tile_shingles))).cast("int").alias("parts"))
    return cut(_confirmed(_in_tiles(_with_sets(docs, cut(named.join(sizes, "clump"))), "clump")))


def classes(docs: DataFrame, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) and kept (its own smallest) of every row."""
    printed = cut(prints(docs))
    roots = components(links(docs, printed, tile, tile_shingles)).withColumnRenamed("node", "digest")
    # Smallest ids are combined per set before the roots are looked up.
    first = printed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    rooted = cut(first.join(roots, "digest", "left").select("digest", "first_id", F.coalesce("root", "digest").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("digest", "component_id")
    found = printed.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
