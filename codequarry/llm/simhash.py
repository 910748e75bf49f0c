"""SimHash near-duplicates through a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint of its three-word shingles. Fingerprints at most 3 bits apart
are linked; documents in one connected component are near-duplicates.

Only distinct fingerprints are searched. They are dealt by bands: of four bands at least one is
equal in any two fingerprints within 3 bits, and of four parts of the remaining 48 bits again one.
So 16 keys of 28 bits bring every linked pair together at least once. A key that many fingerprints
share is dealt again by the bits it doesn't fix, exactly, until few share it or few bits are left;
the number of fingerprints is then bounded by those bits.

Within a key the fingerprints are sorted by Gray rank, so that neighbours share bits, and form a
hierarchy: a node holds the bits that all its members share (mask and pattern). Two nodes are
compared by the differing bits that both have fixed: if these exceed the distance, the groups are
pruned whole; if these and all free bits together don't, the groups are linked whole. Groups already
in one component are skipped. A task emits at most one link per fingerprint and key, a spanning
forest, never all pairs of a group.

Defined results: a null or blank text has fingerprint zero and is linked like any other; a text of
fewer than three words is one shingle; repeated rows share a fingerprint; null ids get the component
of their fingerprint (its smallest non-null id); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import Carried, pick, row_key
from codequarry.llm.components import components
from codequarry.session import cut

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Widths of the bands of each round of dealing; every round leaves the other three quarters of the bits.
LEVELS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6))
#: Keys with more fingerprints are dealt again.
CROWD = 20_000
LEAF = 8


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one whole text, as an unsigned number."""
    # Folding bytes touches A-Z only; splitting bytes uses exactly the six white-space bytes of the word rule.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _prints(plain: DataFrame) -> DataFrame:
    """(doc_id, rid, fp) of (doc_id, rid, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "rid", "fp"])

    return plain.mapInArrow(run, "doc_id bigint, rid bigint, fp bigint")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, rid (64 bits of id and text) and fp (the fingerprint's 64 bits as a signed long) of every row."""
    plain = pick(docs, "doc_id", "text")
    return _prints(plain.select(F.col("doc_id").cast("bigint"), row_key(F.col("doc_id"), F.col("text")).alias("rid"), "text"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Rank of each word in the binary-reflected Gray sequence: the running XOR of its bits from the top."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Forest:
    """Components of the fingerprints of one group, as labels that are merged in bulk."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merges the components of a[i] and b[i] for all i by passing the smaller label on until nothing changes."""
        while True:
            x, y = self.label[a], self.label[b]
            if (x == y).all():
                return
            low, high = np.minimum(x, y), np.maximum(x, y)
            root = np.arange(len(self.label))
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            self.label = root[self.label]


def link_group(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(smallest member, other member) links of all components among distinct unsigned fingerprints."""
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    n = len(fps)
    forest = _Forest(n)
    if n > 1:
        near = np.flatnonzero(np.bitwise_count(fps[1:] ^ fps[:-1]) <= distance)
        forest.join(near, near + 1)
    # Levels of the index from leaves to the root: shared bits of every run of members in Gray order.
    starts = np.arange(0, n, LEAF)
    levels = []
    every = np.bitwise_and.reduceat(fps, starts)
    some = np.bitwise_or.reduceat(fps, starts)
    while True:
        levels.append((starts, np.append(starts[1:], n), ~(every ^ some), every))
        if len(starts) == 1:
            break
        pairs = np.arange(0, len(starts), 2)
        every, some = np.bitwise_and.reduceat(every, pairs), np.bitwise_or.reduceat(some, pairs)
        starts = starts[pairs]

    def whole(level: int) -> np.ndarray:
        """The component of each node that lies within one, -1 of others."""
        first, stop, _, _ = levels[level]
        low, high = np.minimum.reduceat(forest.label, first), np.maximum.reduceat(forest.label, first)
        return np.where(low == high, low, -1)

    # Pairs of nodes, left <= right, from the root down.
    left = right = np.zeros(1, dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        first, stop, mask, pattern = levels[level]
        kept_left, kept_right = [], []
        for at in range(0, len(left), 1 << 20):
            a, b = left[at : at + (1 << 20)], right[at : at + (1 << 20)]
            fixed = mask[a] & mask[b]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & fixed)
            alive = apart <= distance
            sure = alive & (apart + np.bitwise_count(~fixed) <= distance)
            if sure.any():
                # A node in such a pair has at most that many free bits itself, so its members are linked too.
                nodes = np.unique(np.concatenate([a[sure], b[sure]]))
                sizes = stop[nodes] - first[nodes]
                heads = np.repeat(first[nodes], sizes)
                forest.join(heads, heads + np.arange(len(heads)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
                forest.join(first[a[sure]], first[b[sure]])
            comp = whole(level)
            same = (comp[a] >= 0) & (comp[a] == comp[b])
            alive &= ~sure & ~same
            kept_left.append(a[alive])
            kept_right.append(b[alive])
        if not kept_left:
            break
        left, right = np.concatenate(kept_left), np.concatenate(kept_right)
        if level:
            below = len(levels[level - 1][0])
            a = np.concatenate([2 * left, 2 * left, 2 * left + 1, 2 * left + 1])
            b = np.concatenate([2 * right, 2 * right + 1, 2 * right, 2 * right + 1])
            real = (a <= b) & (b < below) & (a < below)
            left, right = a[real], b[real]
    first, stop, _, _ = levels[0]
    for at in range(0, len(left), 1 << 14):
        a, b = left[at : at + (1 << 14)], right[at : at + (1 << 14)]
        offset = np.arange(LEAF)
        x = (first[a][:, None, None] + offset[None, :, None]) + np.zeros((1, 1, LEAF), dtype=np.int64)
        y = (first[b][:, None, None] + offset[None, None, :]) + np.zeros((1, LEAF, 1), dtype=np.int64)
        real = (x < stop[a][:, None, None]) & (y < stop[b][:, None, None])
        x, y = x[real], y[real]
        close = np.bitwise_count(fps[x] ^ fps[y]) <= distance
        forest.join(x[close], y[close])
    order = np.lexsort((fps, forest.label))
    label = forest.label[order]
    heads = np.flatnonzero(np.append(True, label[1:] != label[:-1])) if n else np.zeros(0, dtype=np.int64)
    lowest = np.repeat(fps[order][heads], np.diff(np.append(heads, n)))
    other = fps[order]
    return lowest[lowest != other], other[lowest != other]


def _band_keys(level: int) -> list:
    """Key and remaining bits after one more round of dealing: columns over `key` and `rest`, `rest` right-aligned."""
    widths = LEVELS[level]
    total = sum(widths)
    parts, above = [], total
    for i, width in enumerate(widths):
        above -= width
        band = F.shiftrightunsigned("rest", above).bitwiseAND(F.lit((1 << width) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << above) - 1)) if above else F.lit(0).cast("bigint")
        high = F.shiftleft(F.shiftrightunsigned("rest", above + width), above) if above + width < 64 else F.lit(0).cast("bigint")
        parts.append(F.struct(F.xxhash64("key", F.lit(i), band).alias("key"), high.bitwiseOR(low).cast("bigint").alias("rest")))
    return parts


def _deal(rows: DataFrame, level: int) -> DataFrame:
    """(key, fp, rest): every row under the keys of the next round."""
    return rows.select("fp", F.explode(F.array(*_band_keys(level))).alias("k")).select("k.key", "fp", "k.rest")


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) links between distinct fingerprints (fp), a spanning forest of each key's group."""
    rows = distinct.select(F.lit(0).cast("bigint").alias("key"), "fp", F.col("fp").alias("rest"))
    dealt = _deal(_deal(rows, 0), 1)
    found = None
    for level in range(2, len(LEVELS) + 1):
        crowds = cut(dealt.groupBy("key").count().filter(F.col("count") > crowd).select("key")) if level < len(LEVELS) else None
        crowded = crowds is not None and not crowds.isEmpty()
        calm = dealt.join(crowds, "key", "left_anti") if crowded else dealt
        here = _search(calm)
        found = here if found is None else found.union(here)
        if not crowded:
            break
        dealt = cut(_deal(dealt.join(crowds, "key", "left_semi"), level))
    return found.distinct()


def _search(dealt: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = np.zeros(0, dtype=np.int64)
        held_fp = np.zeros(0, dtype=np.uint64)

        def flush(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
            counts = np.diff(np.append(starts, len(keys)))
            pairs_a, pairs_b = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
            # Groups of two are most of all: one comparison each, all at once.
            two = starts[counts == 2]
            x, y = fps[two], fps[two + 1]
            close = np.bitwise_count(x ^ y) <= DISTANCE
            pairs_a.append(np.minimum(x, y)[close])
            pairs_b.append(np.maximum(x, y)[close])
            for start, count in zip(starts[counts > 2], counts[counts > 2], strict=True):
                a, b = link_group(np.unique(fps[start : start + count]))
                pairs_a.append(a)
                pairs_b.append(b)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).view(np.int64)) for p in (pairs_a, pairs_b)], ["a", "b"])

        for batch in batches:
            held_key = np.concatenate([held_key, batch.column(0).to_numpy()])
            held_fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(held_key) and held_key[0] != held_key[-1]:
                # The last key may go on in the next batch.
                last = int(np.flatnonzero(held_key == held_key[-1])[0])
                yield flush(held_key[:last], held_fp[:last])
                held_key, held_fp = held_key[last:], held_fp[last:]
        yield flush(held_key, held_fp)

    arranged = dealt.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return arranged.mapInArrow(run, "a bigint, b bigint")


def _by_print(prints: DataFrame) -> DataFrame:
    """(fp, root): the component of every distinct fingerprint. Those without a link are their own."""
    distinct = cut(prints.select("fp").distinct())
    roots = components(links(distinct))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return cut(rooted.select("fp", F.coalesce("root", "fp").alias("root")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of the component) of every row."""
    prints = cut(fingerprints(docs))
    rooted = _by_print(prints)
    # Smallest ids are combined per fingerprint before the roots are looked up.
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    ids = rooted.join(first, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows without near-duplicates, and of each group one: the one with the smallest id, with all its columns.

    A null id comes after all others. Of rows equal in id and text one stays.
    """
    prints = cut(fingerprints(docs))
    rooted = _by_print(prints)
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))).alias("first"))
    stay = rooted.join(first, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    repeated = cut(prints.groupBy("rid").count().filter("count > 1").select("rid"))
    frame = Carried(docs)
    keyed = frame.df.withColumn("rid", row_key(frame.col("doc_id"), frame.col("text")))
    kept = keyed.join(cut(stay), "rid", "left_semi")
    if repeated.isEmpty():
        return frame.back(kept)
    once = kept.join(repeated, "rid", "left_anti")
    again = kept.join(repeated, "rid", "left_semi")
    turn = F.row_number().over(Window.partitionBy("rid").orderBy("rid"))
    return frame.back(once.unionByName(again.withColumn("turn", turn).filter("turn = 1").drop("turn")))
