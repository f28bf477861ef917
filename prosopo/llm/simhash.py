"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint holds, bit by bit, the majority over the 64-bit hashes of its 3-word
shingles. Two fingerprints link if they differ in at most ``radius`` bits. The index cuts a
fingerprint into segments. By the pigeonhole principle two linked fingerprints are near in some
segment: with radius r = q*m + a over m segments, within q bits in one of the first a + 1 segments or
within q - 1 in one of the others. So each fingerprint looks up the small Hamming ball around
each of its segments in that segment's table, and each match is verified on the whole distance.

Copies share a fingerprint, so the index holds distinct fingerprints only. A table entry that more
than ``bucket`` fingerprints share would still give pairs by the square; fingerprints that meet such an
entry take an exact way without pairs instead: two fingerprints are within 2h bits if and only if
their balls of radius h share a point, so each is hung on the smallest fingerprint of every point of
its ball. An odd radius has no such h, and takes the pairs of every entry.

Rows: null, empty and blank texts have fingerprint zero and are linked like any other. Rows with the
same id are kept as rows. Ids that are null never name a component. Extra columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prosopo.llm.common import components, texts
from prosopo.session import cut_lineage

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENTS = 2
BUCKET = 256
BATCH = 200_000     #: shingle hashes whose bits are counted at once


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's shingles; of the whole word sequence if it is shorter; none without a word."""
    import xxhash
    words = text.encode().lower().split()   # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(starts[:1 - size].tolist(), ends[size - 1:].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit value (signed, as Spark's long) whose bits are set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BATCH):
        part = hashes[at:at + BATCH].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0].astype(np.int64)) if len(hashes) else 0


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp`` long, computed where the rows are read."""
    data = docs.select(*keep, F.col(text_col).cast("string").alias("text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches, "text__"):
            fp = pa.array([majority(shingle_hashes(t)) for t in values], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), fp], [*keep, "fp"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return data.mapInArrow(run, f"{kinds}, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def ball(bits: int, radius: int) -> list[int]:
    """The masks of at most ``radius`` of the lowest ``bits`` bits, as signed longs."""
    masks = [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def layout(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, ball radius) of each segment that has to be looked up."""
    q, a = divmod(radius, segments)
    width = [BITS // segments + (s < BITS % segments) for s in range(segments)]
    first = [sum(width[:s]) for s in range(segments)]
    return [(first[s], width[s], q if s <= a else q - 1) for s in range(segments) if (q if s <= a else q - 1) >= 0]


def hamming_links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all fingerprints within ``radius``, none beyond it
    but through such steps. Entries of at most ``bucket`` fingerprints give each of their links; larger ones a spanning set."""
    parts = layout(radius, segments)

    def segment(fp: Column, first: int, bits: int) -> Column:
        value = F.shiftrightunsigned(fp, first)
        return value if bits == 64 else value.bitwiseAND(F.lit((1 << bits) - 1))

    def each(pick) -> Column:
        return F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), v.alias("val")) for s, p in enumerate(parts) for v in pick(*p))))

    table = distinct.select("fp", each(lambda first, bits, r: [segment(F.col("fp"), first, bits)]).alias("e")).select("fp", "e.*")
    probes = distinct.select("fp", each(lambda first, bits, r: [segment(F.col("fp"), first, bits).bitwiseXOR(F.lit(m)) for m in ball(bits, r)])
                             .alias("e")).select("fp", "e.*")
    size = table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(size.where(F.col("n") > bucket).select("seg", "val"), "simhash-large")
    hot = radius % 2 == 0 and large.limit(1).count() > 0
    if hot:
        dense = cut_lineage(probes.join(large, ["seg", "val"], "left_semi").select("fp").distinct(), "simhash-dense")
        table = table.join(large, ["seg", "val"], "left_anti")
    left, right = probes.withColumnRenamed("fp", "a"), table.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    links = left.join(right, (left.seg == right.seg) & (left.val == right.val) & (F.col("a") != F.col("b")) & near).select("a", "b")
    if hot:
        points = dense.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(m)) for m in ball(BITS, radius // 2)))).alias("point"))
        least = points.groupBy("point").agg(F.min("fp").alias("b"))
        links = links.union(points.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest reachable id)."""
    fps = cut_lineage(fingerprints(docs, text_col, (id_col,)), "simhash")
    return fps.join(component_ids(fps, id_col, radius, segments, bucket), "fp").select(
        id_col, as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def component_ids(fps: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of (id, fp) rows."""
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    found = components(hamming_links(distinct.select("fp"), radius, segments, bucket), "simhash-links")
    placed = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    linked = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return placed.join(linked, "component").select("fp", "component_id")
