"""Joins. Strategies are left to Spark, which checks sizes before broadcasting."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from prosopo.operators.ordering import LARGE_GROUP_ROWS, large_keys, with_ordinal
from prosopo.session import cut_lineage

PAIRS = 2_000_000       #: pairs that a part of a join of many pairs makes
MOST_PARTS = 10_000


def with_person(fact: DataFrame, person: DataFrame, key: str = "c_personid", prefix: str = "b_") -> DataFrame:
    """fact inner-join person; person columns get ``prefix``."""
    renamed = person.select(*[F.col(c).alias(f"{prefix}{c}") for c in person.columns])
    return fact.join(renamed, F.col(key) == F.col(f"{prefix}{key}"), "inner")


def with_label(fact: DataFrame, codes: DataFrame, fact_key: str, code_key: str, *labels: str,
               name: str) -> DataFrame:
    """fact left-join code table; an unmatched code keeps its row with a NULL label."""
    dim = codes.select(F.col(code_key).alias("__code"), F.coalesce(*[F.col(c) for c in labels]).alias(name))
    return fact.join(dim, F.col(fact_key) == F.col("__code"), "left").drop("__code")


def expand(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str,
           large: int = LARGE_GROUP_ROWS, by: str | None = None) -> DataFrame:
    """left outer join on ``keys`` that fans out, plus the number of matches per left row.

    NULL keys never match. If no key has more than ``large`` matches (:func:`large_keys`), they are counted over the rows of ``right`` as they
    lie dealt for the join, so each side is shuffled once. Otherwise matches per key are counted first, and the fan-out is
    an inner join, of which Spark can split a hot key on either side, which it cannot on
    the right of an outer join; rows without a match are then added.

    ``by`` names a key that has at most ``large`` rows a value on either side, as the caller has measured. Both sides are then dealt by it
    alone, and a later join on it finds the result dealt already.
    """
    right = right.dropna(subset=list(keys))
    known = F.coalesce(F.col(count), F.lit(0)).alias(count)
    if by is not None:
        left, right = left.repartition(by), right.repartition(by)
    if by is not None or large_keys(right, keys, large) is None:
        counted = right.withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        return left.join(counted, list(keys), "left").select(*left.columns, known, *[c for c in right.columns if c not in keys])
    sizes = cut_lineage(right.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)), "sizes")
    # written, so that the next join reads both its sides from shuffles of their own
    marked = cut_lineage(left.join(sizes, list(keys), "left"), "marked")
    matched = marked.where(F.col(count).isNotNull()).join(right, list(keys), "inner")
    lonely = marked.where(F.col(count).isNull()).withColumn(count, F.lit(0).cast("bigint"))
    return (matched.unionByName(lonely, allowMissingColumns=True)
            .select(*left.columns, count, *[c for c in right.columns if c not in keys]))


def fan_out(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left outer join on ``keys`` as an inner join, which Spark can split at a hot key of either side, and the rows without a match.

    Nothing is measured first; both joins deal their sides alike, so they share the shuffles.
    """
    matched = left.join(right, list(keys)).select(*left.columns, *[c for c in right.columns if c not in keys])
    return matched.unionByName(left.join(right, list(keys), "left_anti"), allowMissingColumns=True)


def of_keys(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys occur in ``rows``."""
    return df.join(rows.select(*keys).distinct(), list(keys), "left_semi")


def with_kin_person(kin: DataFrame, person: DataFrame, keep_orphans: bool = True,
                    kin_key: str = "c_kin_id", person_key: str = "c_personid") -> DataFrame:
    """Attach the kin's person row; ``keep_orphans=False`` drops kin without one."""
    named = person.select(*[F.col(c).alias(f"k_{c}") for c in person.columns])
    return kin.join(named, F.col(kin_key) == F.col(f"k_{person_key}"), "left" if keep_orphans else "inner")


def orphans(edges: DataFrame, person: DataFrame, target: str = "c_kin_id", key: str = "c_personid") -> DataFrame:
    """Edges whose target has no person row; a NULL target counts as missing."""
    ids = person.select(F.col(key).alias("__id"))
    return edges.join(ids, F.col(target) == F.col("__id"), "left_anti")


def most_orphans(edges: DataFrame, person: DataFrame, source: str = "c_personid",
                 target: str = "c_kin_id") -> DataFrame:
    """The person with most orphan edges; ties go to the smallest id."""
    return (orphans(edges, person, target).groupBy(source).agg(F.count(F.lit(1)).alias("orphan_count"))
            .orderBy(F.desc("orphan_count"), F.asc(source)).limit(1))


def id_set(ids: DataFrame, id_column: str | None = None) -> DataFrame:
    """Distinct ids, written once: a repeated id then costs nothing, and in joins Spark knows
    the set's size and can split hot keys of the other side."""
    return cut_lineage(ids.select(F.col(id_column or ids.columns[0]).alias("id")).where("id is not null").distinct(), "ids")


def of_ids(df: DataFrame, ids: DataFrame, key: str, id_column: str | None = None) -> DataFrame:
    """Rows whose key is in an id table. Pass :func:`id_set` where ids may repeat a lot."""
    wanted = ids.select(F.col(id_column or ids.columns[0]).alias("__id"))
    return df.join(wanted, F.col(key) == F.col("__id"), "left_semi")


def zip_by_position(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    left_order: Sequence[Column], right_order: Sequence[Column],
                    attach: Sequence[str], verify: Sequence[str] = ()) -> DataFrame:
    """Attach columns of ``right`` to ``left`` by position within each key.

    ``zip_ok`` is false where a row has no partner (lengths differ) or a ``verify``
    column differs, so a misaligned zip shows instead of passing.
    """
    a = with_ordinal(left, keys, left_order, "ordinal").withColumn("__l", F.lit(True))
    b = with_ordinal(right, keys, right_order, "ordinal").select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("ordinal").alias("__o"),
        *[F.col(c).alias(f"__a_{c}") for c in attach], *[F.col(c).alias(f"__v_{c}") for c in verify],
        F.lit(True).alias("__r"))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("ordinal") == F.col("__o")]
    ok = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    for c in verify:
        ok = ok & F.col(c).eqNullSafe(F.col(f"__v_{c}"))
    own = [c for c in left.columns if c not in keys]
    return a.join(b, on, "full_outer").select(
        *[F.coalesce(F.col(k), F.col(f"__k_{k}")).alias(k) for k in keys],
        F.coalesce("ordinal", "__o").alias("ordinal"), *own,
        *[F.col(f"__a_{c}").alias(c) for c in attach], ok.alias("zip_ok"))


def dyadic_cover(windows: DataFrame, low: str, high: str, levels: int = 40) -> DataFrame:
    """``windows`` with (level, block): the aligned blocks of 2^level whole numbers that together are just [low, high].

    At each level at most two blocks belong to a window - a first one with an odd number, a last one with an even number - so a
    window gives at most twice as many rows as its width has binary digits. An empty window gives none.
    """
    spread = windows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    first = F.expr(f"-shiftright(-CAST({low} AS BIGINT), level)")               # of the blocks that lie wholly inside
    last = F.expr(f"shiftright(CAST({high} AS BIGINT) + 1, level) - 1")
    ends = F.array(F.when(F.pmod(first, F.lit(2)) == 1, first), F.when(F.pmod(last, F.lit(2)) == 0, last))
    return spread.where(first <= last).withColumn("block", F.explode(F.array_compact(ends)))


def in_windows(df: DataFrame, value: str, windows: DataFrame, low: str, high: str) -> DataFrame:
    """Inner join of rows and windows [low, high] of whole numbers on low <= value <= high, without unrolling or comparing all with all.

    Windows are cut into aligned blocks (:func:`dyadic_cover`); each different value looks up the blocks it lies in, one a level in
    use. Both sides are logarithmic in the width. A NULL or fractional value and a window with a NULL bound match nothing.
    """
    cover = cut_lineage(dyadic_cover(windows.where(f"{low} is not null and {high} is not null"), low, high), "cover")
    levels = [r["level"] for r in cover.select("level").distinct().collect()]        # at most 41
    if not levels:
        return df.join(windows, F.lit(False), "inner")
    whole = F.col("__value").try_cast("bigint")
    values = (df.select(F.col(value).alias("__value")).distinct().where(whole == F.col("__value"))
              .withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("block", F.expr("shiftright(try_cast(__value AS BIGINT), level)")))
    met = cut_lineage(values.join(cover, ["level", "block"]).drop("level", "block"), "windows-met")
    return _dealt_pairs(df, value, met)


def _dealt_pairs(df: DataFrame, value: str, met: DataFrame) -> DataFrame:
    """Inner join of rows and what their value met (``__value`` and further columns), dealt by the number of pairs.

    Both sides may be small where the pairs are many, so the sides' bytes say nothing about the work: a value's rows are cut into parts of some ``PAIRS``
    pairs, each of which gets a copy of what the value met, and there are as many partitions as the pairs need.
    """
    size = (df.groupBy(F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
            .join(met.groupBy("__value").agg(F.count(F.lit(1)).alias("__w")), "__value")
            .withColumn("__parts", F.least("__n", F.ceil(F.col("__n") * F.col("__w") / PAIRS))))
    size = cut_lineage(size, "pairs")
    pairs = size.agg(F.sum(F.col("__n") * F.col("__w").cast("double"))).first()[0] or 0
    if pairs <= PAIRS:
        return df.join(met, F.col(value) == F.col("__value"), "inner").drop("__value")
    deal = min(MOST_PARTS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * pairs / PAIRS)))
    parts = size.select("__value", "__parts")
    rows = (df.join(parts.withColumnRenamed("__value", "__v"), F.col(value) == F.col("__v"))
            .withColumn("__part", F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not any(w in f.dataType.simpleString() for w in ("map<", "variant"))]), "__parts")).drop("__parts"))
    copies = met.join(parts, "__value").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1))).drop("__parts")
    # joined on one number alone, by which both sides are dealt; two pairs of value and part that share it are told apart afterwards
    rows = rows.withColumn("__at", F.xxhash64("__v", "__part")).repartition(deal, "__at")
    copies = (copies.withColumnRenamed("__part", "__copy").withColumn("__copy_at", F.xxhash64("__value", "__copy"))
              .repartition(deal, "__copy_at").hint("shuffle_hash"))
    same = (F.col("__v") <= F.col("__value")) & (F.col("__v") >= F.col("__value")) & (F.col("__part") - F.col("__copy") == 0)
    return rows.join(copies, (F.col("__at") == F.col("__copy_at")) & same).drop("__v", "__part", "__at", "__value", "__copy", "__copy_at")


def in_dynasty_window(df: DataFrame, dynasties: DataFrame, year: str) -> DataFrame:
    """Attach every dynasty whose start-end window holds the row's year. A missing bound reads as 0."""
    start, end = (F.coalesce(F.col(c), F.lit(0)) for c in ("c_start", "c_end"))
    windows = (dynasties.where(F.col("c_dy").isNotNull() & (start <= end))
               .select(F.col("c_dy").alias("window_dy"), start.alias("window_start"), end.alias("window_end")))
    return in_windows(df, year, windows, "window_start", "window_end")


def dynasty_bounds(dynasties: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per dynasty: (dy, dy, begin, end), a missing bound reading as 0."""
    rows = dynasties.where(F.col("c_dy").isNotNull())
    if ids is not None:
        rows = of_ids(rows, ids, "c_dy")
    return rows.select(F.col("c_dy").alias("from_dynasty"), F.col("c_dy").alias("to_dynasty"),
                       F.coalesce("c_start", F.lit(0)).alias("dynasty_begin"),
                       F.coalesce("c_end", F.lit(0)).alias("dynasty_end"))
