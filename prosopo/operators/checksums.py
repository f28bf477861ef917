"""Keyed comparison by a tree of checksums: only parts that differ are read and compared.

:func:`checksummed` stores a table once, dealt into ``2 ** bits`` leaves by a hash of its key, and the sums of its
rows' hashes for every leaf and for every node above (``STEP`` bits a level). :func:`checksum_diff` walks
down from the root: below a node whose sums agree on both sides nothing is read. The rows of the leaves that are left
are read from their own folders and compared by :func:`prosopo.operators.reconcile.diff`. So two large tables that differ in few
keys cost a few folders, and a table stored once can be compared again and again.

Values are hashed in a form in which equal hashes mean equal values as ``diff`` has it, whatever the types. Where the form is stricter
than ``diff`` (a float against a double), a leaf is read that need not be: an equal key that lies in another leaf on the other side
makes both leaves differ, so the two still meet. A leaf with other rows passes for equal only if count, sum and XOR of
64-bit hashes agree by accident.
"""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from prosopo.functions.exprs import nan_to_null
from prosopo.operators.reconcile import _family, diff, diff_stats, duplicate_keys, exact_text
from prosopo.session import cut_lineage, new_folder

STEP = 5            #: bits of a level
MAX_BITS = 15       #: so at most 32768 leaves, whose numbers may be listed by the driver
_LEAF, _HASH = "__leaf", "__hash"


@dataclass(frozen=True)
class Checksummed:
    """A stored table: ``rows`` with the leaf as partition column, ``sums`` a row for each level and node."""
    keys: tuple[str, ...]
    compare: tuple[str, ...]
    bits: int
    rows: DataFrame
    sums: DataFrame


def _hashed(c: Column, t: T.DataType) -> list[Column]:
    """What is hashed for a value: its kind, whether it is NULL, and a form that only equal values share."""
    family, form = _family(t), c
    if family == "number":
        form = exact_text(c, t)
        if isinstance(t, T.FloatType):      # against other kinds, a float's fraction is equal by rules of the other kind
            wide = c.cast("double")
            form = F.when(F.rint(wide) == wide, form).otherwise(F.concat(F.lit("float:"), c.cast("string")))
    elif isinstance(t, T.NullType):
        form = F.lit(None).cast("string")
    return [F.when(c.isNull(), "null").otherwise(family), form]


def checksummed(df: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None, folder: str | None = None,
                bits: int = 10, on_duplicate: str = "error") -> Checksummed:
    """Stores the keys and compared columns (all others by default) of ``df`` with their sums under ``folder``, which is overwritten.

    Both sides of a comparison name the same keys, columns and bits; a column that ``df`` lacks counts as NULL. Keys must be unique:
    "error" checks it, "trust" does not. A leaf should hold a file's worth of rows; a table of any size has at most ``2 ** MAX_BITS``.
    Its description is written last, so a table whose writing was ended half-way cannot be opened.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits must lie between 0 and {MAX_BITS}")
    if on_duplicate not in ("error", "trust"):
        raise ValueError("on_duplicate must be 'error' or 'trust'")
    spark = df.sparkSession
    folder = folder or new_folder(spark, "checksums")
    compare = [c for c in df.columns if c not in keys] if compare is None else list(compare)
    names = [*keys, *compare]
    df = nan_to_null(df.select(*[n for n in names if n in df.columns]))
    types = {f.name: f.dataType for f in df.schema.fields}
    if missing := [k for k in keys if k not in types]:
        raise ValueError(f"no key columns {missing}")
    forms = {n: _hashed(F.col(f"`{n}`"), types[n]) if n in types else [F.lit("null"), F.lit(None).cast("string")] for n in names}
    key_hash = F.xxhash64(*[x for k in keys for x in forms[k]])
    leaf = F.shiftrightunsigned(key_hash, 64 - bits).cast("int") if bits else F.lit(0)
    # ranges of leaves go to tasks, so a leaf is one file, or few
    (df.withColumns({_LEAF: leaf, _HASH: F.xxhash64(*[x for n in names for x in forms[n]])})
     .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), _LEAF, _HASH)
     .sortWithinPartitions(_LEAF).write.mode("overwrite").partitionBy(_LEAF).parquet(f"{folder}/rows"))
    stored = T.StructType([*df.schema.fields, T.StructField(_HASH, T.LongType()), T.StructField(_LEAF, T.IntegerType())])
    rows = spark.read.schema(stored).parquet(f"{folder}/rows")
    if on_duplicate == "error":
        if example := duplicate_keys(rows, list(keys)).take(1):
            raise ValueError(f"key {list(keys)} is not unique, e.g. {example[0].asDict()}")
    leaves = rows.groupBy(_LEAF).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(_HASH).cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor(_HASH).alias("mix"))
    depth = -(-bits // STEP)
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    node = F.expr(f"shiftright({_LEAF}, greatest(0, {bits} - level * {STEP}))")
    (leaves.select("*", levels).groupBy("level", node.alias("node"))
     .agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mix").alias("mix"))
     .repartition(1).write.mode("overwrite").partitionBy("level").parquet(f"{folder}/sums"))
    about = json.dumps({"keys": list(keys), "compare": compare, "bits": bits, "schema": stored.json()})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")
    return read_checksummed(spark, folder)


def read_checksummed(spark: SparkSession, folder: str) -> Checksummed:
    """A stored table, opened again."""
    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    rows = spark.read.schema(T.StructType.fromJson(json.loads(about["schema"]))).parquet(f"{folder}/rows")
    sums = spark.read.schema("node int, n bigint, total decimal(38,0), mix bigint, level int").parquet(f"{folder}/sums")
    return Checksummed(tuple(about["keys"]), tuple(about["compare"]), about["bits"], rows, sums)


def unequal_leaves(left: Checksummed, right: Checksummed) -> list[int]:
    """Numbers of the leaves that differ, from the root down; a level reads the sums below unequal nodes only.

    The list is bounded by the number of leaves.
    """
    if (left.keys, left.compare, left.bits) != (right.keys, right.compare, right.bits):
        raise ValueError("both sides must be stored by the same keys, columns and bits")
    bits, suspects = left.bits, [0]
    for level in range(-(-bits // STEP) + 1):
        new = min(STEP, bits - (level - 1) * STEP) if level else 0
        asked = [(s << new) + i for s in suspects for i in range(1 << new)]
        here = [s.sums.where((F.col("level") == level) & F.col("node").isin(asked)).select("node", "n", "total", "mix") for s in (left, right)]
        sums = F.struct("n", "total", "mix")
        found = here[0].unionByName(here[1]).groupBy("node").agg(F.count(F.lit(1)).alias("sides"), F.min(sums).alias("low"), F.max(sums).alias("high"))
        suspects = sorted(r["node"] for r in found.where("sides < 2 or low <> high").select("node").collect())
        if not suspects:
            break
    return suspects


def checksum_diff(left: Checksummed, right: Checksummed) -> tuple[DataFrame, DataFrame]:
    """(rows, stats): the rows of :func:`diff` that do not match, and the counters of :func:`diff_stats` over all keys.

    Keys of leaves that agree are counted as matching without being read.
    """
    leaves = unequal_leaves(left, right)
    sides = [s.rows.where(F.col(_LEAF).isin(leaves) if leaves else F.lit(False)).drop(_LEAF, _HASH) for s in (left, right)]
    found = cut_lineage(diff(*sides, left.keys, left.compare, on_duplicate="trust"), "checksum-diff")
    deepest = -(-left.bits // STEP)
    agreed = left.sums.where((F.col("level") == deepest) & ~F.col("node").isin(leaves)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stats = diff_stats(found).withColumns({c: F.col(c) + F.lit(agreed) for c in ("rows_left", "rows_right", "rows_matching")})
    return found.where("bucket <> 'match'"), stats
