"""Hierarchical multi-length packing of tokenised documents.

A document's ids (its text's, then one end id) are cut into whole windows and a rest. The rest goes to
the tier of its size (powers of two up to the window). Each tier is packed best-fit: rests of the longest
tier open windows whose gaps are filled from the shorter tiers, longest fitting rest first, and closed
by cutting one more rest; what then remains in a short tier makes sequences of exactly that tier's
length. Sequences are dealt to step groups so that each group holds about as many tokens.

Packing happens where a document is tokenised, pool by pool, so no id is ever shuffled. A pool is
bounded by a number of ids, whatever the input's size. Padding is left only at the end of an input
partition, at most one window each.

Rows: null text is the empty text (the end id alone). Every row is packed, repeated ids too; an empty
table gives no piece; extra columns are not read.
"""
from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from prosopo.llm.common import texts

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
POOL_IDS = 2_000_000     #: ids held before a pool is packed
STEP_TOKENS = 65_536     #: tokens of a step group
#: How the vocabulary splits text before merging: fixed value of that public vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int64()), ("step_group", pa.int64())])

_encoders: dict[str, object] = {}


def byte_encoder(path: str, special: dict[str, int]):
    """Text to ids for a byte-level vocabulary given as ranks; the special strings in a text become their ids."""
    if path not in _encoders:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        enc = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        _encoders[path] = lambda text: enc.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    return _encoders[path]


@dataclass(slots=True)
class Rest:
    """A piece waiting for a place."""
    doc: int | None
    start: int
    ids: np.ndarray
    total: int

    def cut(self, n: int) -> tuple["Rest", "Rest"]:
        return Rest(self.doc, self.start, self.ids[:n], self.total), Rest(self.doc, self.start + n, self.ids[n:], self.total)


@dataclass
class Tier:
    """Rests of one size class, by length."""
    rests: list[Rest] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def add(self, r: Rest) -> None:
        at = bisect.bisect_right(self.sizes, len(r.ids))
        self.sizes.insert(at, len(r.ids))
        self.rests.insert(at, r)

    def take(self, most: int) -> Rest | None:
        """The longest rest of at most ``most`` ids."""
        at = bisect.bisect_right(self.sizes, most) - 1
        if at < 0:
            return None
        self.sizes.pop(at)
        return self.rests.pop(at)


class Packer:
    """Packs rests pool by pool; yields sequences as (tier, pieces)."""

    def __init__(self, window: int = WINDOW, tiers: tuple[int, ...] = TIERS):
        self.window, self.tiers = window, tiers
        self.pool = {t: Tier() for t in tiers}
        self.held = 0

    def route(self, r: Rest) -> None:
        self.pool[next(t for t in self.tiers if len(r.ids) <= t)].add(r)
        self.held += len(r.ids)

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple[int, list[Rest]]]:
        n, whole = len(ids), len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            yield self.window, [Rest(doc, at, ids[at:at + self.window], n)]
        if whole < n:
            self.route(Rest(doc, whole, ids[whole:], n))

    def close(self, length: int, pieces: list[Rest], usable: list[int]) -> tuple[int, list[Rest]]:
        """Fills a sequence of ``length`` from the usable tiers, longest fitting rest first; cuts the one that closes it."""
        gap = length - sum(len(p.ids) for p in pieces)
        while gap:
            got = next((r for t in reversed(usable) if (r := self.pool[t].take(gap))), None)
            if got is None:
                # every usable rest is longer than the gap: the shortest of them is cut
                t = next((t for t in usable if self.pool[t].sizes), None)
                if t is None:
                    break
                whole = self.pool[t].rests.pop(0)
                self.pool[t].sizes.pop(0)
                got, rest = whole.cut(gap)
                self.held -= len(whole.ids)
                self.route(rest)
                self.held += gap
            pieces.append(got)
            self.held -= len(got.ids)
            gap -= len(got.ids)
        return gap, pieces

    def pack(self, last: bool) -> Iterator[tuple[int, list[Rest]]]:
        """Packs the pool; what fills no sequence waits for the next pool, or with ``last`` goes out as it is."""
        short = list(self.tiers[:-1])
        top = self.pool[self.tiers[-1]]
        while top.sizes:
            first = top.take(self.window)
            self.held -= len(first.ids)
            gap, pieces = self.close(self.window, [first], short)
            if gap and top.sizes:
                gap, pieces = self.close(self.window, pieces, [self.tiers[-1]])
            if gap and not last:
                for p in pieces:
                    self.route(p)
                break
            if gap:
                yield from self.tail(pieces)
            else:
                yield self.window, pieces
        for t in reversed(short):
            while sum(self.pool[t].sizes) >= t:
                yield t, self.close(t, [], [t])[1]
        if last:
            rest = [r for t in self.tiers for r in self.pool[t].rests]
            self.pool = {t: Tier() for t in self.tiers}
            while rest:
                pieces, room = [], self.window
                while rest and room:
                    r = rest.pop()
                    if len(r.ids) > room:
                        r, more = r.cut(room)
                        rest.append(more)
                    pieces.append(r)
                    room -= len(r.ids)
                if room:
                    yield from self.tail(pieces)
                else:
                    yield self.window, pieces

    def tail(self, pieces: list[Rest]) -> Iterator[tuple[int, list[Rest]]]:
        """The end of a partition: whole tiers first, then one sequence that is padded."""
        have = sum(len(p.ids) for p in pieces)
        for t in reversed(self.tiers):
            if have >= t:
                out, need = [], t
                while need:
                    p = pieces.pop()
                    if len(p.ids) > need:
                        p, more = p.cut(need)
                        pieces.append(more)
                    out.append(p)
                    need -= len(p.ids)
                have -= t
                yield t, out
        if pieces:
            yield self.window, pieces


def step_groups(tokens: list[int], step_tokens: int) -> list[int]:
    """A group number per sequence: the longest first, each to the group with the fewest tokens."""
    import heapq
    heap = [(0, g) for g in range(max(1, round(sum(tokens) / step_tokens)))]
    out = [0] * len(tokens)
    for i in sorted(range(len(tokens)), key=lambda i: -tokens[i]):
        have, g = heap[0]
        out[i] = g
        heapq.heapreplace(heap, (have + tokens[i], g))
    return out


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, special: dict[str, int] | None = None,
                   window: int = WINDOW, tiers: tuple[int, ...] = TIERS, pool_ids: int = POOL_IDS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``path`` names a byte-level vocabulary as ranks; ``special`` the strings with ids of their own.
    """
    special = special or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = byte_encoder(path, special), Packer(window, tiers)
        base = TaskContext.get().partitionId() << 32
        made: list[tuple[int, list[Rest]]] = []
        count = {"sequence": base, "group": base, "ids": 0}

        def out() -> pa.RecordBatch:
            sizes = [sum(len(p.ids) for p in pieces) for _, pieces in made]
            groups = step_groups(sizes, step_tokens)
            cols: list[list] = [[] for _ in PIECES]
            for (tier, pieces), group in zip(made, groups):
                offset = 0
                for p in pieces:
                    for c, v in zip(cols, (p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total,
                                           count["sequence"], offset, tier, count["group"] + group)):
                        c.append(v)
                    offset += len(p.ids)
                count["sequence"] += 1
            count["group"] += max(groups, default=-1) + 1
            count["ids"] = 0
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, PIECES)], schema=PIECES)

        for batch, values in texts(batches):
            for doc, text in zip(batch.column(0).to_pylist(), values):
                ids = np.append(encode(text), np.uint32(end_id))
                made.extend(packer.add(doc, ids))
                count["ids"] += len(ids)
                if count["ids"] >= pool_ids:
                    made.extend(packer.pack(last=False))
                    yield out()
        made.extend(packer.pack(last=True))
        if made:
            yield out()

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"))
