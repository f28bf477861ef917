"""Exact top-k inner products by norm buckets.

Vectors are sorted by length and cut into blocks, the norm buckets. A first pass over the longest bucket
gives each query a score it is sure to reach; with it a bucket of greatest length l has the local cosine
threshold ``score / (|query| * l)``. Over 1: no vector of the bucket can enter. Else the bucket's
candidates are pruned by length (a prefix of the bucket), or, when the threshold is high, by
coordinates: a unit vector within that cosine of the query has each coordinate in an interval. What
is left is verified by its exact product. Queries meet buckets in blocks, so a task holds one block of each.

Rows: a vector that is null, or holds a null or non-finite component, takes no part. The zero vector takes part
(score 0). A query is not compared with rows of its own id; other repeated rows are rows of their own, and
a repeated query row gets its own ranks. Vectors of different lengths count as filled up with zeros. An empty
table gives no row. Extra columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from prosopo.session import cut_lineage

BUCKET = 4096        #: vectors of a bucket, at most
QUERIES = 512        #: queries of a query block, at most
FOCUS = 4            #: coordinates looked at when pruning by coordinates
COORDINATE = 0.6     #: local thresholds from here prune by coordinates
SLACK = 1e-9         #: bounds are loosened by so much, for rounding

BLOCK = "block long, n int, dim int, longest double, ids binary, vectors binary, norms binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(x.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"))


def pack(ids: np.ndarray, mat: np.ndarray, norms: np.ndarray, block: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block], pa.int64()), "n": pa.array([len(ids)], pa.int32()), "dim": pa.array([mat.shape[1]], pa.int32()),
        "longest": [float(norms[0])], "ids": [ids.astype("<i8").tobytes()], "vectors": [mat.astype("<i8").tobytes()], "norms": [norms.astype("<f8").tobytes()]})


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """(id, v) rows of integer vectors, sorted by length within partitions, as blocks of at most ``size``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        vs: list[list[int]] = []

        def out() -> pa.RecordBatch:
            nonlocal number
            dim = max(map(len, vs))
            mat = np.array([v + [0] * (dim - len(v)) for v in vs], np.int64).reshape(len(vs), dim)
            norms = np.sqrt((mat.astype(np.float64) ** 2).sum(axis=1))
            order = np.argsort(-norms, kind="stable")
            number += 1
            batch = pack(np.array(ids, np.int64)[order], mat[order], norms[order], number)
            ids.clear(), vs.clear()
            return batch

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is not None:
                    ids.append(i), vs.append(v)
                if len(ids) == size:
                    yield out()
        if ids:
            yield out()

    return rows.select("id", "v").mapInArrow(run, BLOCK)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def products(mat: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every sum fits their 53 bits, else in Python's integers."""
    if not mat.size or np.abs(mat.astype(np.float64)).max() * np.abs(q.astype(np.float64)).max(initial=0) * mat.shape[1] < 2 ** 53:
        return (mat.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return np.array(mat.astype(object) @ q.astype(object), np.int64)


def search_block(ids: np.ndarray, mat: np.ndarray, norms: np.ndarray, q_id: int, q: np.ndarray, k: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of a query's k best in a bucket sorted by falling length, of those that reach ``sure``."""
    length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
    keep = np.arange(len(ids))
    if sure > 0:
        if length == 0 or norms[0] == 0 or sure / (length * norms[0]) > 1 + SLACK:
            return ids[:0], norms[:0].astype(np.int64)
        keep = keep[:np.searchsorted(-norms, -sure / length * (1 - SLACK), side="right")]
        local = min(1.0, sure / (length * norms[0]))
        if local >= COORDINATE:
            unit = q / length
            slack = SLACK + 1e-7
            for f in np.argsort(-np.abs(unit))[:FOCUS]:
                wide = np.sqrt(max(0.0, (1 - local ** 2) * (1 - unit[f] ** 2)))
                x = mat[keep, f] / norms[keep]
                low = local * unit[f] - wide if unit[f] > -local else -1.0
                high = local * unit[f] + wide if unit[f] < local else 1.0
                keep = keep[(x >= low - slack) & (x <= high + slack)]
    keep = keep[ids[keep] != q_id]
    scores = products(mat[keep], q)
    if sure > -np.inf:
        reach = scores >= sure
        keep, scores = keep[reach], scores[reach]
    at = best(scores, ids[keep], k)
    return ids[keep[at]], scores[at]


def unpack(n: int, dim: int, ids: bytes, vectors: bytes, norms: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(n, dim), np.frombuffer(norms, "<f8")


def fit_dims(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, d - m.shape[1]))) if m.shape[1] < d else m for m in (a, b))


def search(vectors: DataFrame, queries: DataFrame, k: int, bucket: int = BUCKET, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of (id, v) rows with integer vectors: each query's ``k`` best rows of ``vectors``."""
    def sure_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qi, qm, _ = unpack(r["q_n"], r["q_dim"], r["q_ids"], r["q_vectors"], r["q_norms"])
                ids, mat, norms = unpack(r["n"], r["dim"], r["ids"], r["vectors"], r["norms"])
                qm, mat = fit_dims(qm, mat)
                sure = np.full(len(qi), -np.inf)
                for j, q in enumerate(qm):
                    got = search_block(ids, mat, norms, qi[j], q, k, -np.inf)[1]
                    if len(got) == k:
                        sure[j] = got[-1]
                lengths = np.frombuffer(r["q_norms"], "<f8")
                # a bucket whose greatest length times this is under 1 can improve no query
                reach = float(np.max(lengths / sure)) if (sure > 0).all() else float("inf")
                yield pa.RecordBatch.from_pydict({"q_block": pa.array([r["q_block"]], pa.int64()), "sure": [sure.astype("<f8").tobytes()], "reach": [reach]})

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qi, qm, _ = unpack(r["q_n"], r["q_dim"], r["q_ids"], r["q_vectors"], r["q_norms"])
                ids, mat, norms = unpack(r["n"], r["dim"], r["ids"], r["vectors"], r["norms"])
                qm, mat = fit_dims(qm, mat)
                sure = np.frombuffer(r["sure"], "<f8") if r["sure"] is not None else np.full(len(qi), -np.inf)
                rows = []
                for j, q in enumerate(qm):
                    found, scores = search_block(ids, mat, norms, qi[j], q, k, sure[j])
                    rows += [(r["q_block"], j, int(qi[j]), int(v), int(s)) for v, s in zip(found, scores)]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(5)], ["q_block", "q_row", "query_id", "vec_id", "score"])

    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    ranged = vectors.withColumn("length", length).repartitionByRange(F.col("length").desc()).sortWithinPartitions(F.col("length").desc(), "id")
    buckets = cut_lineage(blocks_of(ranged, bucket), "topk-buckets")
    asked = blocks_of(queries, query_block).drop("longest").toDF("q_block", "q_n", "q_dim", "q_ids", "q_vectors", "q_norms")
    asked = cut_lineage(asked, "topk-queries")
    first = buckets.orderBy(F.col("longest").desc(), "block").select("block").first()
    if first is None:
        first = (0,)
    sure = cut_lineage(asked.withColumn("block", F.lit(first[0]).cast("long")).join(buckets, "block").mapInArrow(
        sure_scores, "q_block long, sure binary, reach double"), "topk-sure")
    # the stated queries against all rows, block by block: only block numbers are paired, and not where no query can profit
    pairs = asked.select("q_block").join(sure, "q_block", "left").join(
        buckets.select("block", "longest"), F.col("longest") * F.coalesce("reach", F.lit(float("inf"))) >= 1 - SLACK).select("q_block", "sure", "block")
    scored = pairs.join(asked, "q_block").join(buckets, "block").mapInArrow(rank, "q_block long, q_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q_block", "q_row").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
