"""Importance resampling towards a target, with features counted once for each distinct line.

A text is cut into lines at newlines, which separate words, so no word crosses a line. The words and n-grams inside a line depend on
the line alone: each distinct line is cut into features once, and its bucket counts are multiplied by how often the line occurs.
The n-grams that reach over line ends are cut from each text apart, from the last words of a line and the first of the next, and added.

A bucket's gain is the logarithm of its share in the target over that in the corpus. A text's weight is the mean gain of its features,
from the gains of its lines (joined by a 128-bit digest of the line) and of its crossing n-grams; the texts with the highest
weight plus Gumbel noise are drawn, which samples without replacement in proportion to exp(weight).

What grows with the corpus stays in tables: lines meet their occurrences in a join that adaptive execution splits where a line
is hot; only a count a bucket comes to the driver, and a gain a bucket goes to tasks. Ranks are places in a range-partitioned order.

Rows: null and empty texts, and texts without a word, have no feature and weight 0. Texts of any length are read whole; a line's features
take two bytes each. Repeated ids, null ids (hashed as ``null``) and repeated rows are rows of their own, each drawn for itself. Ties go to the smaller id.
An empty table gives no row; an empty target gives gains from the corpus alone. Extra columns are not read.
"""
from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prosopo.llm.common import own_rows, ship
from prosopo.operators.ordering import with_position
from prosopo.session import cut_lineage

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KNOWN = 500_000      #: words whose checksums are remembered at once


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return WORD.findall(text.encode().lower())      # bytes.lower() knows A-Z only


class Sums(dict):
    """Checksums by word: of the word, and of the word with a blank after it."""
    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= KNOWN:
            self.clear()
        crc = zlib.crc32(word)
        out = self[word] = (crc, zlib.crc32(b" ", crc))
        return out


def features(words: list[bytes], longest: int, buckets: int, sums: Sums) -> np.ndarray:
    """The buckets of all runs of 1 to ``longest`` words."""
    known = [sums[w] for w in words]
    crcs, ends = [k[0] for k in known], [k[1] for k in known]
    for n in range(1, longest):
        runs = [zlib.crc32(w, e) for w, e in zip(words[n:], ends)]     # ends: of the run of n words before, with its blank
        crcs += runs
        ends = [zlib.crc32(b" ", c) for c in runs] if n + 1 < longest else []
    return (np.array(crcs, np.uint32) % np.uint32(buckets)).astype(np.uint16)


def crossing(lines: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The buckets of the runs of up to ``longest`` words that reach over a line end."""
    out: list[int] = []
    before: list[bytes] = []       # up to longest - 1 words before the line end
    for line in lines:
        head, tail = line_ends(line, longest - 1)
        for start in range(len(before)):
            run = zlib.crc32(b" ".join(before[start:]))
            for w in head[:longest - (len(before) - start)]:
                run = zlib.crc32(w, zlib.crc32(b" ", run))
                out.append(run)
        if head:
            before = (before + tail)[-(longest - 1):] if len(tail) < longest - 1 else tail
    return (np.array(out, np.uint32) % np.uint32(buckets)).astype(np.uint16)


def line_ends(line: bytes, n: int) -> tuple[list[bytes], list[bytes]]:
    """The first and the last ``n`` words of a line; those at the end are found backwards."""
    head, tail, at = [], [], len(line)
    for m in WORD.finditer(line):
        head.append(m.group())
        if len(head) == n:
            break
    if len(head) < n:
        return head, head
    while len(tail) < n:
        piece = line[:at][max(0, at - 200):] if at > 200 else line[:at]
        found = list(WORD.finditer(piece))
        if not found or (found[0].start() == 0 and len(found) <= n - len(tail) and at > 200):
            return head, WORD.findall(line)[-n:]      # long words or much white space: look at the whole line
        found = found[-(n - len(tail)):]
        tail = [m.group() for m in found] + tail
        at = at - len(piece) + found[0].start()
    return head, tail


def line_features(lines: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(h0, h1, n, words, found) of each distinct line of (line, n): its digest, occurrences, words and feature buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            words, found = [], []
            for line in batch.column(3).to_pylist():
                w = words_of(line)
                words.append(len(w)), found.append(features(w, longest, buckets, sums).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(words, pa.int64()), pa.array(found, pa.binary())], ["h0", "h1", "n", "words", "found"])

    return lines.select(*digest(), "n", "line").mapInArrow(run, "h0 long, h1 long, n long, words long, found binary").where("words > 0")


def digest() -> list:
    return [F.xxhash64("line").alias("h0"), F.xxhash64(F.lit("second"), "line").alias("h1")]


def crossing_features(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(row, id, found) of (row, id, text): the buckets of the n-grams over line ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [crossing(t.encode().lower().split(b"\n"), longest, buckets).tobytes() if longest > 1 and "\n" in t else b"" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["row", "id", "found"])

    return rows.select("row", "id", "text").mapInArrow(run, "row long, id long, found binary")


def bucket_totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, of (n, found) rows: added up in tasks, then by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found = batch.column(1).to_pylist()
            times = np.repeat(batch.column(0).to_numpy(), [len(f) // 2 for f in found])
            values = np.frombuffer(b"".join(found), np.uint16)
            total += np.bincount(values, weights=times, minlength=buckets).astype(np.int64)     # exact below 2 ** 53
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, object)
    for b, n in counted.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():      # a row a bucket
        out[b] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)), each bucket counted once more than found."""
    buckets = len(corpus)
    s_all, t_all = float(sum(corpus) + buckets), float(sum(target) + buckets)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(corpus, target)], np.int64)


def gain_sums(found: DataFrame, table: np.ndarray, keep: str) -> DataFrame:
    """The kept columns and the summed gains of ``found``."""
    shared = found.sparkSession.sparkContext.broadcast(table)       # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(batch.num_columns - 1).to_pylist()
            ends = np.cumsum([0] + [len(p) // 2 for p in parts])
            run_ = np.concatenate([[0], np.cumsum(shared.value[np.frombuffer(b"".join(parts), np.uint16)])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(run_[ends[1:]] - run_[ends[:-1]], pa.int64())], [*batch.schema.names[:-1], "gain"])

    names = [c.split()[0] for c in keep.split(", ")]
    return found.select(*names, "found").mapInArrow(run, f"{keep}, gain long")


def counted_lines(rows: DataFrame, longest: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The written features of distinct lines and of crossings of (row, id, text)."""
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return (cut_lineage(line_features(lines, longest, buckets), "resample-lines"),
            cut_lineage(crossing_features(rows, longest, buckets), "resample-crossings"))


def totals_of(lines: DataFrame, across: DataFrame, buckets: int) -> np.ndarray:
    return bucket_totals(lines.select("n", "found").union(across.where(F.length("found") > 0).select(F.lit(1).cast("long"), "found")), buckets)


def resample(docs: DataFrame, target: DataFrame, percent: int, least_words: int, longest: int = 2, buckets: int = 10_000, seed: str = "7",
             id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``; rank is null where the row was not drawn.

    ``percent`` of the rows with at least ``least_words`` words are drawn, rounded down.
    """
    if not 0 < buckets <= 65536 or longest < 1:
        raise ValueError("buckets must lie in 1..65536 and longest be 1 or more")
    ship(docs.sparkSession)
    rows = own_rows(docs, id_col, text_col)
    lines, across = counted_lines(rows, longest, buckets)
    wanted = target.select(F.lit(0).cast("long").alias("row"), F.col(target_id).cast("long").alias("id"), F.coalesce(F.col(target_text).cast("string"), F.lit("")).alias("text"))
    table = gains(totals_of(lines, across, buckets), totals_of(*counted_lines(wanted, longest, buckets), buckets))
    weighed = gain_sums(lines, table, "h0 long, h1 long, words long")
    met = rows.select("row", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").select("row", *digest())
    by_row = met.join(weighed, ["h0", "h1"]).groupBy("row").agg(F.sum("words").alias("words"), F.sum("gain").alias("line_gain"))
    words = F.coalesce("words", F.lit(0))
    n = sum((F.greatest(words - k, F.lit(0)) for k in range(1, longest)), words)
    gain = F.coalesce("line_gain", F.lit(0)) + F.col("gain")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = (gain_sums(across, table, "row long, id long").join(by_row, "row", "left")
              .select("row", "id", words.alias("words"), n.cast("long").alias("n_features"), gain.alias("gain"))
              .withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long"))
              .select("row", "id", "words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score")))
    scored = cut_lineage(scored, "resample-scored")
    able = scored.where(F.col("words") >= least_words).select("row", "id", "score")
    drawn = percent * able.count() // 100
    ranked = with_position(able, [F.col("score").desc(), F.col("id").asc_nulls_last()], "rank").where(F.col("rank") <= drawn).select("row", "rank")
    return scored.join(ranked, "row", "left").select("id", "n_features", "weight", "score", "rank")
