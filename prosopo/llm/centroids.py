"""Exact k-means over integer vectors by shallot search.

Vectors lie in blocks, written once and bucketed by block number; what a vector remembers - nearest and second-nearest
centroid, an upper bound of the distance to the first and a lower bound of the distance to all others - lies in a table of the
same buckets, written anew each round, so that a round is a scan of both without an exchange. In a round a vector

1. shifts its bounds by how far the centroids moved, and is done where they, or half the way to the centroid's closest
   neighbour, leave no other centroid;
2. else measures both remembered centroids and starts from the closer one;
3. scans that one's neighbours by rising distance, as long as they lie within the ball of the distance to it and the
   second-smallest distance so far; the ball shrinks with every closer one found;
4. compares those that survive by integer squared distance, so results are exact and do not depend on how rows are dealt.

Only the sums of vectors that changed their centroid are carried into the next centroids; what comes to the driver is a number
a centroid and component. A round in which none changed ends the loop, as all further ones would be alike.

Rows: vectors of another length, or that are null or hold null or non-finite components, take no part. A null id is kept and starts no
centroid while others can. Repeated rows and ids are rows of their own. Fewer vectors than centroids give fewer centroids; an empty table
gives no row. A centroid without vectors stays where it is. Components beyond ``largest(dim)`` - 190 million at 64
components - are an error, as squared distances would leave 64 bits. Extra columns are not read.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from prosopo.llm.common import ship
from prosopo.session import bucket_count, bucketed, cut_lineage

BLOCK = 4096         #: vectors of a block, at most
SLACK = 1e-9         #: bounds are loosened by so much, for rounding

_STATE = "block long, near binary, second binary, upper binary, lower binary, changed int, moved binary"


def largest(dim: int) -> int:
    """The largest component for which a squared distance fits 63 bits."""
    return int(math.isqrt((2 ** 63 - 1) // max(dim, 1)) // 2)


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, dim: int, scale: float) -> DataFrame:
    """(id, v) of the rows whose vector has ``dim`` finite components, each as ``floor(scale * x)``."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fits = F.forall(x, lambda e: F.abs(e.cast("double") * scale) < float(2 ** 62))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    return (rows.where(x.isNotNull() & (F.size(x) == dim) & ~F.coalesce(bad, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"), F.when(fits, v).otherwise(F.array_repeat(F.lit(2 ** 62), dim)).alias("v")))


def blocks_of(vectors: DataFrame, dim: int, size: int) -> DataFrame:
    """(block, ids, ints) of (id, v) rows: blocks of at most ``size`` rows, in 32-bit integers."""
    limit = largest(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ints = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ints) and max(-int(ints.min()), int(ints.max())) > limit:
                    raise ValueError(f"a component is larger than {limit}")
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, part.num_rows], part.column(0)),
                                                  pa.array([ints.astype("<i4").tobytes()], pa.binary())], ["block", "ids", "ints"])
                number += 1

    return vectors.select("id", "v").mapInArrow(run, "block long, ids array<long>, ints binary")


@dataclass
class Round:
    """The centroids of a round and what the search needs to know of them."""
    centroids: np.ndarray    # (k, dim) integers
    moves: np.ndarray        # how far each came since the last round

    def __post_init__(self):
        c = self.centroids.astype(np.float64)
        k = len(c)
        apart = np.sqrt(np.maximum(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2), 0)) if k else np.zeros((0, 0))
        np.fill_diagonal(apart, -1)                       # a centroid leads its own list
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.away = np.take_along_axis(apart, self.order, axis=1)
        self.half = self.away[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        far = np.argsort(-self.moves, kind="stable")      # the farthest move of any other centroid
        self.others = np.full(k, self.moves[far[0]] if k else 0.0)
        if k:
            self.others[far[0]] = self.moves[far[1]] if k > 1 else 0.0


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def first_search(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(nearest, second, smallest and second-smallest squared distance) over all centroids; ties to the smaller number."""
    n, big = len(x), np.iinfo(np.int64).max
    near, second = np.zeros(n, np.int32), np.full(n, -1, np.int32)
    d1, d2 = np.full(n, big), np.full(n, big)
    for j, c in enumerate(centroids):
        d = squared(x, c)
        first, then = d < d1, d < d2
        second = np.where(first, np.where(d1 < big, near, -1), np.where(then, j, second)).astype(np.int32)
        d2 = np.where(first, d1, np.where(then, d, d2))
        near, d1 = np.where(first, j, near).astype(np.int32), np.where(first, d, d1)
    return near, second, d1, d2


def root(d: np.ndarray) -> np.ndarray:
    return np.where(d == np.iinfo(np.int64).max, np.inf, np.sqrt(d.astype(np.float64)))


def shallot(x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Round) -> tuple[np.ndarray, ...]:
    """(nearest, second, upper, lower, products) after the centroids moved; products counts measured distances."""
    c = now.centroids
    near, second = near.copy(), second.copy()
    upper, lower = upper + now.moves[near], lower - now.others[near]
    measured = 0

    def open_(of: np.ndarray) -> np.ndarray:
        return of[~(upper[of] * (1 + SLACK) + SLACK < np.maximum(lower[of], now.half[near[of]]))]

    todo = open_(np.arange(len(x)))
    d_near = squared(x[todo], c[near[todo]])
    measured += len(todo)
    upper[todo] = np.sqrt(d_near.astype(np.float64))
    left = np.isin(todo, open_(todo), assume_unique=True)
    todo, d1 = todo[left], d_near[left]
    if len(c) == 1 or not len(todo):
        return near, second, upper, lower, measured
    one, two = near[todo], second[todo]
    d2 = squared(x[todo], c[two])
    measured += len(todo)
    swap = (d2 < d1) | ((d2 == d1) & (two < one))
    one, two, d1, d2 = np.where(swap, two, one), np.where(swap, one, two), np.where(swap, d2, d1), np.where(swap, d1, d2)
    centre, known, reach = one.copy(), two.copy(), np.sqrt(d1.astype(np.float64))
    scan = np.arange(len(todo))
    for t in range(len(c) - 1):
        # the ball: any centroid nearer than the second one lies no farther from the centre than both distances together
        scan = scan[now.away[centre[scan], t] <= (reach[scan] + np.sqrt(d2[scan].astype(np.float64))) * (1 + SLACK) + SLACK]
        if not len(scan):
            break
        j = now.order[centre[scan], t]
        fresh = j != known[scan]
        at, j = scan[fresh], j[fresh].astype(np.int32)
        d = squared(x[todo[at]], c[j])
        measured += len(at)
        first = (d < d1[at]) | ((d == d1[at]) & (j < one[at]))
        then = ~first & (d < d2[at])
        a = at[first]
        two[a], d2[a], one[a], d1[a] = one[a], d1[a], j[first], d[first]
        a = at[then]
        two[a], d2[a] = j[then], d[then]
    near[todo], second[todo] = one, two
    upper[todo], lower[todo] = np.sqrt(d1.astype(np.float64)), np.sqrt(d2.astype(np.float64))
    return near, second, upper, lower, measured


def sums_by(x: np.ndarray, cluster: np.ndarray, k: int, out: np.ndarray, sign: int) -> None:
    """Adds (or takes) counts and component sums to ``out`` (k, 1 + dim)."""
    order = np.argsort(cluster, kind="stable")
    found, starts = np.unique(cluster[order], return_index=True)
    if len(found):
        out[found, 1:] += sign * np.add.reduceat(x[order], starts, axis=0)
        out[found, 0] += sign * np.bincount(cluster, minlength=k)[found]


def assign(blocks: DataFrame, state: DataFrame | None, now: Round, dim: int, buckets: int) -> DataFrame:
    """The state after a round, as a table of the blocks' buckets; ``moved`` holds the block's change of the sums."""
    k, first = len(now.centroids), state is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["ints"], "<i4").reshape(-1, dim).astype(np.int64)
                moved = np.zeros((k, 1 + dim), np.int64)
                if first:
                    near, second, d1, d2 = first_search(x, now.centroids)
                    upper, lower, changed = root(d1), root(d2), np.arange(len(x))
                else:
                    before = np.frombuffer(r["near"], "<i4")
                    near, second, upper, lower, _ = shallot(x, before, np.frombuffer(r["second"], "<i4"), np.frombuffer(r["upper"], "<f8"),
                                                            np.frombuffer(r["lower"], "<f8"), now)
                    changed = np.flatnonzero(near != before)
                    sums_by(x[changed], before[changed], k, moved, -1)
                sums_by(x[changed], near[changed], k, moved, 1)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([r["block"]], pa.int64()), "near": [near.astype("<i4").tobytes()], "second": [second.astype("<i4").tobytes()],
                    "upper": [upper.astype("<f8").tobytes()], "lower": [lower.astype("<f8").tobytes()], "changed": pa.array([len(changed)], pa.int32()),
                    "moved": pa.array([moved.astype("<i8").tobytes() if len(changed) else None], pa.binary())})

    rows = blocks.select("block", "ints")
    if state is not None:
        rows = rows.join(state.select("block", "near", "second", "upper", "lower").hint("shuffle_hash"), "block")
    return bucketed(rows.mapInArrow(run, _STATE), ["block"], buckets, "centroids-state")


def change_of(state: DataFrame, k: int, dim: int) -> tuple[int, list[list[int]]]:
    """(vectors that changed, change of count and sums by centroid): added up in tasks, then by number; k * (1 + dim) numbers come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 1 + dim), dtype=object)
        changed = 0
        for batch in batches:
            changed += sum(batch.column(0).to_pylist())
            for m in batch.column(1).to_pylist():
                if m is not None:
                    total += np.frombuffer(m, "<i8").reshape(k, 1 + dim).astype(object)
        at = [i for i in range(k * (1 + dim)) if total.flat[i]]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * bool(changed) + at, pa.int32()), pa.array([str(changed)] * bool(changed) + [str(total.flat[i]) for i in at])], ["at", "n"])

    found = dict(state.where("changed > 0").select("changed", "moved").mapInArrow(run, "at int, n string")
                 .groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect())
    return int(found.get(-1, 0)), [[int(found.get(i * (1 + dim) + j, 0)) for j in range(1 + dim)] for i in range(k)]


def cluster(vectors: DataFrame, dim: int, k: int, rounds: int, seed_order: Column, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of (id, v) rows, and the final centroids.

    The first ``k`` rows by ``seed_order``, then by value, are the first centroids. Each of ``rounds`` rounds assigns all vectors and
    replaces the centroids by floored means; then vectors are assigned once more.
    """
    spark = ship(vectors.sparkSession)
    seeds = [r["v"] for r in vectors.orderBy(F.col("id").isNull(), seed_order, "id", "v").limit(k).select("v").collect()]
    if not seeds:
        return spark.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, dim), np.int64)
    if max(abs(x) for s in seeds for x in s) > largest(dim):
        raise ValueError(f"a component is larger than {largest(dim)}")
    centroids = np.array(seeds, np.int64).reshape(len(seeds), dim)
    k, buckets = len(seeds), bucket_count(spark)
    blocks = bucketed(blocks_of(vectors, dim, block), ["block"], buckets, "centroids-blocks")
    now, state = Round(centroids, np.zeros(k)), None
    totals = [[0] * (1 + dim) for _ in range(k)]
    for number in range(rounds + 1):
        state = assign(blocks, state, now, dim, buckets)
        if number == rounds:
            break
        changed, change = change_of(state, k, dim)
        if not changed:
            break
        totals = [[a + b for a, b in zip(t, c)] for t, c in zip(totals, change)]
        after = np.array([[s // t[0] for s in t[1:]] if t[0] else list(old) for t, old in zip(totals, now.centroids.tolist())], np.int64).reshape(k, dim)
        now = Round(after, np.sqrt(((after - now.centroids).astype(np.float64) ** 2).sum(axis=1)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_py(), "<i4").reshape(-1, dim).astype(np.int64)
                near = np.frombuffer(batch.column(2)[i].as_py(), "<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(near, pa.int32()), pa.array(squared(x, now.centroids[near]), pa.int64())],
                                                 ["id", "cluster", "distance"])

    placed = (blocks.join(state.select("block", "near").hint("shuffle_hash"), "block").select("ids", "ints", "near")
              .mapInArrow(rows, "id long, cluster int, distance long"))
    return cut_lineage(placed, "centroids-placed"), now.centroids


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (distance summed over the cluster and over all) and centroid_sha256; one value a centroid is looked up."""
    sums = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum("distance")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, sums.get(i, 0), sum(sums.values()), d) for i, d in enumerate(digest)]
    known = placed.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster")      # a row a centroid
