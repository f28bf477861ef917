"""Orders, positions, first and last per key, clamps.

A person, code or place may own a large share of all rows, so nothing here puts
one key's rows into one task:

* first / last / top-n per key use ``row_number() <= n``, which Spark prunes before
  the shuffle (window group limit), so a hot key ships n rows per map task;
* full positions of keys above a size limit, and global positions, are counted
  over range partitions and shifted by the rows before them.

Every path breaks ties alike: by the remaining columns, by value (:func:`total_order`).
So a row's position does not depend on how many rows its key has, on the page asked for,
or on where rows were read; rows that tie even then are equal.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from prosopo.session import cut_lineage

LARGE_GROUP_ROWS = 1_000_000
KEY_BINS = 1 << 16

_ROW, _PART, _BEFORE, _BIN = "__row", "__part", "__before", "__bin"


def nulls_first(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def total_order(df: DataFrame, order: Sequence[Column], last: bool = False) -> list[Column]:
    """``order``, then all columns by value, NULL first (``last``: the reverse); a column already ordered decides nothing more.

    Maps and variants have no order: they are compared by their JSON text.
    """
    def value(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        odd = any(w in f.dataType.simpleString() for w in ("map<", "variant"))
        return F.to_json(c) if odd else c
    values = [value(f) for f in df.schema.fields]
    return [*order, *(v.desc_nulls_last() if last else v.asc_nulls_first() for v in values)]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``. NULL keys form a key of their own."""
    return top_per_key(df, keys, order, 1)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in the ascending order of the named columns."""
    return top_per_key(df, keys, total_order(df, [F.col(c).desc_nulls_last() for c in order], last=True), 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                name: str | None = None, large: int = LARGE_GROUP_ROWS) -> DataFrame:
    if n > 999:  # above Spark's group-limit threshold a hot key would not be pruned early
        out = with_ordinal(df, keys, order, name or _ROW, large).where(F.col(name or _ROW) <= n)
    else:
        window = Window.partitionBy(*keys).orderBy(*total_order(df, order))
        out = df.withColumn(name or _ROW, F.row_number().over(window)).where(F.col(name or _ROW) <= n)
        out = out.withColumn(name, F.col(name).cast("bigint")) if name else out
    return out if name else out.drop(_ROW)


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ordinal",
                 large: int = LARGE_GROUP_ROWS) -> DataFrame:
    """1-based position of each row among the rows of its key.

    Sizes are measured first (:func:`large_keys`). Keys within
    ``large`` rows go through a plain window; larger ones through
    :func:`_ranged_ordinal`.
    """
    if not keys:
        return _ranged_ordinal(df, [], order, name)
    big = large_keys(df, keys, large)
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*total_order(df, order))).cast("bigint")
    if big is None:
        return df.withColumn(name, plain)
    small_rows = _null_safe(df, big, keys, "left_anti").withColumn(name, plain)
    big_rows = _ranged_ordinal(_null_safe(df, big, keys, "left_semi"), keys, order, name)
    return small_rows.unionByName(big_rows)


def large_keys(df: DataFrame, keys: Sequence[str], large: int) -> DataFrame | None:
    """The keys of more than ``large`` rows, written, or None if there are none.

    Rows are first counted in ``KEY_BINS`` bins of a hash of the key, so a task sends at most that many numbers and not its keys.
    A large key's bin holds more than ``large`` rows, too, so only the keys of such bins are counted, and exactly.
    """
    bins = df.select(*keys).withColumn(_BIN, F.pmod(F.xxhash64(*keys), F.lit(KEY_BINS)))
    full = cut_lineage(bins.groupBy(_BIN).count().where(F.col("count") > large).select(_BIN), "large-bins")
    if not full.take(1):
        return None
    big = cut_lineage(bins.join(full, _BIN, "left_semi").groupBy(*keys).count().where(F.col("count") > large).select(*keys), "large-keys")
    return big if big.take(1) else None


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based position of each row in one global order, without a single-task window."""
    return _ranged_ordinal(df, [], order, name)


def _null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    other = other.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(other, on, how)


def _ranged_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Positions for keys of any size.

    Rows are range-partitioned by (key, order), so every key covers neighbouring
    partitions. A row's position is its place within its partition plus the key's
    rows in earlier partitions. All columns take part in the ranges, so that equal order values spread.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = df.columns
    spread = [*nulls_first(*keys), *total_order(df, order)]
    placed = cut_lineage(
        df.repartitionByRange(parts, *spread).withColumn(_PART, F.spark_partition_id()), "ranged")
    # one row per (key, partition); per key at most `parts` rows, so this window is bounded
    sizes = placed.groupBy(*keys, _PART).count()
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_PART).rowsBetween(
        Window.unboundedPreceding, -1)
    before = (sizes.withColumn(_BEFORE, F.sum("count").over(earlier))
              .where(F.col(_BEFORE) > 0).select(*keys, _PART, _BEFORE))
    # only the key a partition begins with can have rows before it: at most one row
    # per partition, so `before` has at most `parts` rows
    local = F.row_number().over(Window.partitionBy(*keys, _PART).orderBy(*total_order(df, order)))
    before = F.broadcast(before.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(_PART).alias("__k_part"), _BEFORE))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col(_PART) == F.col("__k_part")]
    return (placed.withColumn(_ROW, local).join(before, on, "left")
            .select(*columns, (F.col(_ROW) + F.coalesce(F.col(_BEFORE), F.lit(0))).cast("bigint").alias(name)))


def row_limit(limit: int, cap: int | None = None) -> int:
    """At least 1; a limit above a ``cap`` the caller named is an error, never silently less."""
    if cap is not None and limit > cap:
        raise ValueError(f"limit {limit} is above the cap of {cap}")
    return max(1, int(limit))


def first_rows(df: DataFrame, order: Sequence[Column], limit: int | None, offset: int = 0,
               cap: int | None = None) -> DataFrame:
    """Sorted, from ``offset``, ``limit`` rows or all of them. Pages over the same rows neither repeat nor lose any."""
    by = total_order(df, order)
    if not offset:
        ordered = df.orderBy(*by)
        return ordered if limit is None else ordered.limit(row_limit(limit, cap))
    at = F.col("__at")
    placed = with_position(df, order, "__at").where(at > offset)
    if limit is not None:
        placed = placed.where(at <= offset + row_limit(limit, cap))
    return placed.orderBy(at).drop("__at")
