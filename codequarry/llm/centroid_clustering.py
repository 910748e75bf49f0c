"""Centroid clustering with bounds that are loosened by the norm of a sum (ns-bounds).

Lloyd's rounds over whole-number vectors, exact to the last digit. Every vector keeps, for each
centroid, its squared distance when that was last evaluated and the round of that evaluation. The
centroids of all rounds are retained, so a stored distance is loosened by how far its centroid stands
from where it stood then: the norm of its total displacement, never more than the sum of its drifts
of every round. A centroid whose lower bound exceeds the upper bound of the vector's own can't be
nearest and isn't looked at. The others fail the test; their distances are evaluated exactly, own
centroid first, and stored with the new round.

One round is one pass without a shuffle: the table of vectors and bounds is read, judged in Arrow
batches and written to the shared folder, so a lost executor costs a part of one round. Vectors that
changed their cluster then add to or leave the sums of whole numbers of their clusters; only those
k x dims sums reach the driver, from which the exact new centroids follow.

Defined results: vectors that are null, of another length, or hold a null or non-finite component
are left out. Components are floor(scale * x), held to +-2^27 so that squared distances fit a long
(x up to 524,288 at scale 256; larger ones count as that bound). Repeated rows are vectors of their
own, also among the first centroids, of which equal ones leave the later empty. Null ids come last
among the candidates for first centroids. With fewer vectors than k there are as many centroids as
vectors; an empty table gives an empty result. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import pick
from codequarry.session import cut

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256.0
SEED = "2"
BOUND = 1 << 27
#: Square roots are floats; every bound is loosened by this share of what it is made of.
SLACK = 1e-9
STATE = "vec_id bigint, v array<int>, d2 array<bigint>, seen array<tinyint>, cluster int, was int"


@dataclass(frozen=True)
class Clustering:
    """rows: vec_id, cluster, distance (squared); centroids: the final ones."""

    rows: DataFrame
    centroids: list[tuple[int, ...]]


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """vec_id and v (whole numbers) of the usable vectors of a (vec_id, embedding) table."""
    plain = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.greatest(F.least(F.floor(x * F.lit(scale)), F.lit(BOUND)), F.lit(-BOUND)).cast("int")
    return plain.filter((F.size("e") == dims) & F.coalesce(finite, F.lit(False))).select("vec_id", F.transform("e", whole).alias("v"))


def first_centroids(whole: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> list[tuple[int, ...]]:
    """The vectors of the k smallest digests of `seed:vec_id`; equal ones in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = whole.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k)
    return [tuple(row["v"]) for row in chosen.collect()]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.reshape(-1), kind))


def _matrix(column: pa.ListArray, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def nearest_from_bounds(
    vectors: np.ndarray, d2: np.ndarray, seen: np.ndarray, own: np.ndarray, history: np.ndarray
) -> tuple[np.ndarray, int]:
    """The nearest centroid of the last round for every vector; d2 and seen take up what is evaluated. And how many were.

    history holds the centroids of every round (round, centroid, component).
    """
    now = len(history) - 1
    centroids = history[now]
    rows = np.arange(len(vectors))
    # moved[t, j]: how far centroid j stands from where it stood in round t.
    moved = np.sqrt(((history - centroids) ** 2).sum(axis=2).astype(np.float64))
    every = np.arange(len(centroids))
    lower = np.sqrt(d2.astype(np.float64)) * (1 - SLACK) - moved[seen, every] * (1 + SLACK)
    upper = np.sqrt(d2[rows, own].astype(np.float64)) + moved[seen[rows, own], own]

    def failing(upper: np.ndarray) -> np.ndarray:
        near = lower <= (upper * (1 + SLACK))[:, None]
        near[rows, own] = False
        return near

    def evaluate(r: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(r), 1 << 14):
            a, b = r[at : at + (1 << 14)], j[at : at + (1 << 14)]
            d2[a, b] = ((vectors[a] - centroids[b]) ** 2).sum(axis=1)
            seen[a, b] = now

    near = failing(upper)
    # Own centroids first: with the exact distance most of the others pass.
    stale = near.any(axis=1) & (seen[rows, own] != now)
    evaluate(rows[stale], own[stale])
    upper = np.where(stale, np.sqrt(d2[rows, own].astype(np.float64)), upper)
    r, j = np.nonzero(failing(upper) & (seen != now))
    evaluate(r, j)
    # Whatever has been evaluated now competes by exact distance; ties go to the smaller number.
    exact = np.where(seen == now, d2, np.iinfo(np.int64).max)
    found = np.where((seen == now).any(axis=1), exact.argmin(axis=1), own)
    # A vector whose bounds all held keeps its centroid, whose distance may be an old one.
    return np.where(near.any(axis=1), found, own), int(stale.sum()) + len(r)


def _start(whole: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    """State after the first assignment, for which every distance is evaluated."""
    dims, first = len(centroids[0]), np.array(centroids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dims, np.int64)
            d2 = np.stack([((v - c) ** 2).sum(axis=1) for c in first], axis=1)
            yield _state(batch.column("vec_id"), v, d2, np.zeros(d2.shape, np.int8), d2.argmin(axis=1), np.full(len(v), -1))

    return whole.select("vec_id", "v").mapInArrow(run, STATE)


def _state(ids: pa.Array, v: np.ndarray, d2: np.ndarray, seen: np.ndarray, cluster: np.ndarray, was: np.ndarray) -> pa.RecordBatch:
    columns = [ids, _lists(v.astype(np.int32), pa.int32()), _lists(d2, pa.int64()), _lists(seen, pa.int8())]
    names = ["vec_id", "v", "d2", "seen", "cluster", "was"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(cluster, pa.int32()), pa.array(was, pa.int32())], names)


def _again(state: DataFrame, history: list[list[tuple[int, ...]]]) -> DataFrame:
    """State after one more assignment."""
    past = np.array(history, dtype=np.int64)
    k, dims = past.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, d2 = _matrix(batch.column("v"), dims, np.int64), _matrix(batch.column("d2"), k, np.int64).copy()
            seen, own = _matrix(batch.column("seen"), k, np.int8).copy(), batch.column("cluster").to_numpy().astype(np.int64)
            found, _ = nearest_from_bounds(v, d2, seen, own, past)
            yield _state(batch.column("vec_id"), v, d2, seen, found, own)

    return state.mapInArrow(run, STATE)


def _changes(state: DataFrame, dims: int) -> DataFrame:
    """Per cluster, what the vectors that came and went change of its count (n) and sums (s0, s1, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            v = _matrix(batch.column("v"), dims, np.int64)
            # The count rides along as one more component.
            v = np.concatenate([v, np.ones((len(v), 1), np.int64)], axis=1)
            for name, sign in (("cluster", 1), ("was", -1)):
                of = batch.column(name).to_numpy()
                for j in np.unique(of[of >= 0]).tolist():
                    sums[j] = sums.get(j, 0) + sign * v[of == j].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), _lists(np.array(list(sums.values())), pa.int64())], ["cluster", "sums"])

    moved = state.filter("cluster != was").select("v", "cluster", "was").mapInArrow(run, "cluster int, sums array<bigint>")
    add = lambda i: F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}")
    return moved.groupBy("cluster").agg(*[add(i) for i in range(dims + 1)])


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: str = SEED) -> Clustering:
    """Assigns, moves the centroids to the floored means, `rounds` times, and assigns once more."""
    whole = whole_vectors(vectors, dims, scale)
    start = first_centroids(whole, k, seed)
    if not start:
        return Clustering(whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), [])
    history = [start]
    sums = [[0] * (dims + 1) for _ in start]
    state = cut(_start(whole, start))
    for _ in range(rounds):
        for row in _changes(state, dims).collect():
            sums[row["cluster"]] = [a + int(row[f"s{i}"]) for i, a in enumerate(sums[row["cluster"]])]
        # Whole-number division floors; an empty cluster keeps its centroid.
        history.append([tuple(s // total[-1] for s in total[:-1]) if total[-1] else old for total, old in zip(sums, history[-1], strict=True)])
        state = cut(_again(state, history))
    return Clustering(_measured(state, history[-1]), history[-1])


def _measured(state: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    """vec_id, cluster and the exact squared distance to its final centroid."""
    last = np.array(centroids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cluster")
            away = _matrix(batch.column("v"), last.shape[1], np.int64) - last[own.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), own, pa.array((away**2).sum(axis=1), pa.int64())], ["vec_id", "cluster", "distance"])

    return cut(state.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id bigint, cluster int, distance bigint"))


def centroid_digest(centroid: tuple[int, ...]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _long(total: Column) -> Column:
    """A sum as a long; beyond that the largest long."""
    return F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")


def with_inertia(found: Clustering) -> DataFrame:
    """rows with cluster_inertia and inertia (distance summed over the cluster and over all) and centroid_sha256.

    What is joined has one row per centroid.
    """
    if not found.centroids:
        return found.rows.withColumns({"cluster_inertia": F.col("distance"), "inertia": F.col("distance"), "centroid_sha256": F.lit("")})
    sums = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")).collect()
    total = sum(int(row["part"]) for row in sums)
    top = (1 << 63) - 1
    table = [(row["cluster"], min(int(row["part"]), top), min(total, top), centroid_digest(found.centroids[row["cluster"]])) for row in sums]
    of = found.rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
