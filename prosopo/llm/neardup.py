"""Embedding near-duplicates by counting collisions of one-dimensional projections.

All vectors, scaled to length one, are projected on ``groups * depth`` random directions. Two vectors collide in
a projection if the second lies in the window of half-width ``window`` around the first. The number
of collisions separates near pairs from far ones: pairs with at least ``needed`` collisions are verified by
their cosine in double precision. ``needed`` is calibrated: of pairs exactly at the threshold no more than
``miss`` is expected to have fewer collisions.

To count without comparing all pairs, the projections are sorted in groups of ``depth``: each projection's axis
is cut into cells as wide as two windows, shifted at random, and only vectors in one cell of a group are
counted and compared. ``groups`` is chosen from the same binomial model so that a pair at the
threshold shares a cell of some group but with probability ``miss``; ``depth`` grows with the logarithm of the
number of vectors, so that a cell of unrelated vectors stays small. A pair is counted only in the first group whose
cell it shares, so no pair is counted twice and none has to be shuffled: a task returns, per vector, the number
of its links and one edge to its block's component, never pairs.

Exact copies are one class with a weight. A cell with more than ``block`` classes is dealt over pairs of blocks, whole.

Rows: vectors that are null, empty, zero, or hold null or non-finite components are kept with no link. Rows that
share an id are one node. Copies have cosine one and are linked. An empty table gives no row. Extra columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prosopo.llm.common import components
from prosopo.session import cut_lineage

BLOCK = 1024         #: classes of a block; a larger cell is dealt over pairs of blocks
COUNTED = 64         #: projections whose collisions are counted
EARLY = 16           #: of these, counted first
GROWTH = 0.5         #: how fast the depth grows with the number of vectors
PAIRS = 400_000      #: pairs counted at once
BUFFER = 20_000      #: rows of a task that are solved together
SEED = 20240501


@dataclass(frozen=True)
class Plan:
    """The projections and the count a pair must reach."""
    dim: int
    depth: int
    groups: int
    window: float
    counted: int
    needed: int
    seed: int = SEED

    def directions(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(self.dim, self.groups * self.depth))

    def shifts(self) -> np.ndarray:
        return np.random.default_rng(self.seed + 1).uniform(0, self.width, size=self.groups * self.depth)

    @property
    def width(self) -> float:
        return 2 * self.window

    def cells(self, projected: np.ndarray) -> np.ndarray:
        """(vector, group) cell numbers."""
        at = np.floor((projected + self.shifts()) / self.width).astype(np.int64).reshape(len(projected), self.groups, self.depth)
        mixed = np.zeros(at.shape[:2], np.uint64)
        for k in range(self.depth):
            mixed = (mixed ^ at[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        return mixed.astype(np.int64)


def same_cell(distance: float, width: float) -> float:
    """Probability that two points whose difference is normal with this deviation lie in one cell, shifted at random."""
    x = np.linspace(0, width, 2001)
    density = np.exp(-x ** 2 / (2 * distance ** 2)) * math.sqrt(2 / math.pi) / distance
    return float(np.trapezoid(density * (1 - x / width), x))


def calibrate(n: int, dim: int, threshold: float, miss: float, window: float = 1.0) -> Plan:
    """Depth, number of groups and collision count for ``n`` vectors and pairs of cosine ``threshold``."""
    near, far = math.sqrt(2 - 2 * threshold), math.sqrt(2)
    depth = max(1, math.ceil(GROWTH * math.log(max(n, 2)) / -math.log(same_cell(far, 2 * window))))
    share = same_cell(near, 2 * window) ** depth
    groups = max(1, math.ceil(math.log(miss / 2) / math.log1p(-share)))
    counted, p = min(COUNTED, groups * depth), math.erf(window / (near * math.sqrt(2)))
    # the largest count that a pair at the threshold falls short of with probability miss / 2 at most
    below, needed = 0.0, 0
    for k in range(counted + 1):
        below += math.comb(counted, k) * p ** k * (1 - p) ** (counted - k)
        if below > miss / 2:
            needed = k
            break
    return Plan(dim, depth, groups, window, counted, needed)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, of ``n`` nodes and edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Rows:
    """Vectors dealt to a task, with their cells and their projections in steps of 1/64 of a window."""

    def __init__(self, plan: Plan, directions: np.ndarray, vectors: np.ndarray):
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        projected = self.unit @ directions
        self.cells = plan.cells(projected)
        # a difference of 64 steps is the window; one step more is let through, for rounding
        self.steps = np.clip(np.rint(projected[:, :plan.counted] * (64 / plan.window)), -16000, 16000).astype(np.int16)

    def collisions(self, i: np.ndarray, j: np.ndarray, first: int, last: int) -> np.ndarray:
        return (np.abs(self.steps[i, first:last] - self.steps[j, first:last]) <= 65).sum(axis=1)


def partners(run: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by run and part: each row's first partner and number of partners, all after it.

    Within one block a row meets the rows after it; between two blocks a row of the left meets those of the right.
    """
    n = len(run)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if n else np.empty(0, np.int64)
    ends = np.r_[starts[1:], n]
    end = np.repeat(ends, ends - starts)
    n_left = np.add.reduceat((part == left).astype(np.int64), starts) if n else starts
    middle = np.repeat(starts + n_left, ends - starts)
    inside = left == right
    at = np.where(inside, np.arange(n) + 1, middle)
    return at, np.where(inside | (part == left), end - at, 0)


def near_pairs(plan: Plan, rows: Rows, group: np.ndarray, at: np.ndarray, count: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of rows, of those that no earlier group holds."""
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    bounds = np.r_[0, np.cumsum(count)]
    row = 0
    while row < len(count):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PAIRS, side="right")) - 1)
        c = count[row:last]
        i = np.repeat(np.arange(row, last), c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(at[row:last], c)
        row = last
        allowed = plan.counted - plan.needed
        head = min(EARLY, plan.counted)
        hits = rows.collisions(i, j, 0, head)
        ok = head - hits <= allowed          # the rest cannot reach the count any more
        i, j, hits = i[ok], j[ok], hits[ok]
        ok = hits + rows.collisions(i, j, head, plan.counted) >= plan.needed
        i, j = i[ok], j[ok]
        earlier = np.argmax(rows.cells[i] == rows.cells[j], axis=1) < group[i]
        i, j = i[~earlier], j[~earlier]
        close = np.einsum("ij,ij->i", rows.unit[i], rows.unit[j]) >= threshold
        out_a.append(i[close]), out_b.append(j[close])
    return np.concatenate(out_a), np.concatenate(out_b)


LINKS = "id long, links long, root long"


def links(classes: DataFrame, plan: Plan, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, links, root) partial results of (id, weight, v) classes: links to others, and a node of the same component."""
    directions = plan.directions()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack([np.asarray(x, np.float64) for x in batch.column(2).to_numpy(zero_copy_only=False)])
            cells = plan.cells((v / np.linalg.norm(v, axis=1, keepdims=True)) @ directions)
            take = np.repeat(np.arange(len(v)), plan.groups)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(plan.groups), len(v))), pa.array(cells.ravel()),
                batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)),
                pa.array([r.tobytes() for r in v.astype("<f4" if (v.astype(np.float32) == v).all() else "<f8")], pa.binary()).take(pa.array(take))],
                ["grp", "cell", "id", "weight", "v"])

    # a vector without company in a cell is dropped before the vectors are dealt out
    keys = "grp long, cell long, id long, weight long, v binary"
    dealt = classes.mapInArrow(deal, keys)
    size = cut_lineage(dealt.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "neardup-cells")
    parts = F.ceil(F.col("n") / block)
    placed = (dealt.join(size, ["grp", "cell"]).withColumn("parts", parts)
              .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
              .select("grp", "cell", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "id", "weight", "v"))

    def solve(buffer: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(buffer).combine_chunks()
        group, cell, left, right, part, ids, weights = (t.column(c).to_numpy() for c in ("grp", "cell", "left", "right", "part", "id", "weight"))
        raw = t.column("v").to_pylist()
        rows = Rows(plan, directions, np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * plan.dim else "<f8").astype(np.float64) for r in raw]))
        change = np.r_[False, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])]
        a, b = near_pairs(plan, rows, group, *partners(np.cumsum(change), part, left, right), threshold)
        found = np.zeros(len(ids), np.int64)
        np.add.at(found, a, weights[b])
        np.add.at(found, b, weights[a])
        order = np.argsort(ids, kind="stable")     # so that the smallest place has the smallest id
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = ids[order][roots(len(order), place[a], place[b])[place]]
        keep = found > 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids, found, root)], ["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Solves whole runs of equal keys; a run is at most two blocks."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in range(4)]
            same = np.all([k == k[-1] for k in keys], axis=0)
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0     # where the last run begins
            if cut:
                held.append(batch.slice(0, cut))
                if sum(x.num_rows for x in held) >= BUFFER:
                    yield solve(held)
                    held = []
            elif held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in range(4)) and sum(x.num_rows for x in held) >= BUFFER:
                yield solve(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(held)

    runs = ["grp", "cell", "left", "right"]
    return placed.select(*runs, "part", "id", "weight", "v").repartition(*runs).sortWithinPartitions(*runs, "part").mapInArrow(run, LINKS)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                    miss: float = 0.005, window: float = 1.0, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: its id, n_links, component_id, kept."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    nonzero = F.exists(x, lambda v: v != 0)
    usable = F.coalesce(~bad & nonzero, F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable, x).alias("v"))
    good = rows.where("v is not null").select("id", F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)).alias("v")).dropDuplicates(["id"])
    keyed = cut_lineage(good.select("id", "v", F.xxhash64("v").alias("h"), F.hash("v").alias("h2"), F.size("v").alias("dim")), "neardup")
    # copies: one class, named by its smallest id
    classes = cut_lineage(keyed.groupBy("h", "h2", "dim").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("weight")), "neardup-classes")
    member = keyed.select("id", "h", "h2", "dim").join(classes, ["h", "h2", "dim"]).select("id", "class", "weight")
    parts = []
    for dim, n in sorted(tuple(r) for r in classes.groupBy("dim").count().collect()):      # vectors of different length never link
        plan = calibrate(n, dim, threshold, miss, window)
        one = keyed.where(F.col("dim") == dim).join(classes.select(F.col("class").alias("id"), "weight"), "id").select("id", "weight", "v")
        parts.append(links(one, plan, threshold, block))
    if not parts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    found = cut_lineage(every, "neardup-links")
    degree = found.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "neardup-components")
    placed = (member.join(degree, "class", "left").join(comp.withColumnRenamed("node", "class"), "class", "left")
              .select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id")))
    return (rows.select("id").join(placed, "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept")))
