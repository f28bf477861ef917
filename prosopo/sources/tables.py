"""Writing tables, where they came from, and whether they can be used again."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from prosopo.session import cut_lineage

PROVENANCE = ("product string, source_sha string, path string, builder_version string, "
              "tables bigint, rows bigint, built_at timestamp, started boolean")


def write_tables(tables: Mapping[str, DataFrame], folder: str, skipped: Sequence[str] = ()) -> DataFrame:
    """Overwrite ``folder/<table>`` for each table.

    Gives one row of build statistics: tables_created, rows_inserted, tables_skipped.
    Rows are counted while they are written.
    """
    rows = 0
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}")
        rows += seen.get["n"]
    return spark.createDataFrame([(len(tables), rows, sorted(skipped))],
                                 "tables_created bigint, rows_inserted bigint, tables_skipped array<string>")


def _as_text(c: str) -> Column:
    """The value with its length before it, so that no value can look like a column's border."""
    v = F.col(c).cast("string")
    return F.coalesce(F.concat(F.length(v).cast("string"), F.lit("="), v), F.lit("~"))


def fingerprint(df: DataFrame, digest: str = "xxhash64") -> DataFrame:
    """(rows, hash_sum, hash_xor): equal for equal row multisets in any order.

    ``xxhash64`` is the fast choice; ``md5`` gives values any other engine can recompute
    (first 60 bits of the MD5 of the columns, each ``length=value`` or ``~`` for NULL).
    """
    if digest == "xxhash64":
        # xxhash64 skips NULLs, so their places are hashed too
        h = F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns])
    elif digest == "md5":
        h = F.conv(F.substring(F.md5(F.concat(*[_as_text(c) for c in df.columns])), 1, 15), 16, 10).cast("bigint")
    else:
        raise ValueError("digest must be 'xxhash64' or 'md5'")
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"))


def file_hashes(spark: SparkSession, path: str, digest: str = "xxhash64") -> DataFrame:
    """(path, length, lines, hash_sum, hash_xor) of staged text or binary files; never cached.

    A line is hashed with its number in the file, so the order of lines counts. Files are read line by line and split like any text, so none is held
    whole: rows before a line are counted within its split and over the splits before it. ``length`` is the file's own, so a missing last
    line break shows too. ``xxhash64`` is the fast choice; with ``md5`` any other engine can recompute the values (first 60 bits of the MD5 of number, colon and line).
    """
    if digest not in ("xxhash64", "md5"):
        raise ValueError("digest must be 'xxhash64' or 'md5'")
    line = F.col("value").cast("binary")
    read = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), (F.xxhash64(line) if digest == "xxhash64" else line).alias("line"))
    # written once: a second reading could split and number the rows otherwise. Rows of a split are numbered one after the other
    rows = cut_lineage(read, "file-lines")
    splits = rows.groupBy("path", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)     # a row a split
    splits = splits.select("path", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    number = F.col("row") + F.col("shift")
    h = (F.xxhash64(number, "line") if digest == "xxhash64"
         else F.conv(F.substring(F.md5(F.concat(number.cast("string").cast("binary"), F.lit(b":"), F.col("line"))), 1, 15), 16, 10).cast("bigint"))
    return (rows.join(splits, ["path", "block"]).select("path", "length", h.alias("h"))
            .groupBy("path", "length").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor")))


def record_build(spark: SparkSession, folder: str, product: str, source_sha: str, path: str, builder_version: str, stats: DataFrame | None = None) -> None:
    """Appends a provenance row: without ``stats`` that the build of a product has started, with them that it is done."""
    row = spark.createDataFrame([(product, source_sha, path, builder_version)], "product string, source_sha string, path string, builder_version string")
    counts = ([F.lit(None).cast("bigint").alias("tables"), F.lit(None).cast("bigint").alias("rows")] if stats is None
              else [F.col("tables_created").alias("tables"), F.col("rows_inserted").alias("rows")])
    rows = row if stats is None else row.join(stats.select("tables_created", "rows_inserted").limit(1), how="cross")    # one row by one row
    (rows.select("product", "source_sha", "path", "builder_version", *counts, F.current_timestamp().alias("built_at"), F.lit(stats is None).alias("started"))
     .write.mode("append").parquet(folder))


def read_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each product; ``started`` is true where its last build did not end."""
    rows = spark.read.schema(PROVENANCE).parquet(folder)
    last = rows.groupBy("product").agg(F.max_by(F.struct(*rows.columns), F.struct("built_at", ~F.col("started"))).alias("r"))
    return last.select("r.*")


def reusable(provenance: DataFrame, wanted: DataFrame) -> DataFrame:
    """Products that need no rebuild.

    ``wanted`` is (product, source_sha, path, builder_version, file_bytes). A product is
    reusable iff the recorded source, path and builder version are the wanted ones and
    its file is there and not empty.
    """
    keys = ["product", "source_sha", "path", "builder_version"]
    if "started" in provenance.columns:
        provenance = provenance.where(~F.col("started"))
    return wanted.where(F.coalesce(F.col("file_bytes"), F.lit(0)) > 0).join(
        provenance.select(*keys).distinct(), keys, "left_semi")


def current_provenance(provenance: DataFrame, source_sha: str) -> DataFrame:
    """A new source makes every product of the old one stale."""
    return provenance.where(F.col("source_sha") == source_sha)


def after_failure(provenance: DataFrame, started: DataFrame) -> DataFrame:
    """A failed build removes only the products it had started on."""
    return provenance.join(started.select("product"), "product", "left_anti")


def same_source(provenance: DataFrame, left: str, right: str, expected_paths: Mapping[str, str] | None = None) -> DataFrame:
    """May two products be compared? (same_source, paths_ok, allowed)."""
    side = lambda p: provenance.where(F.col("product") == p)
    one = provenance.agg(
        F.max(F.when(F.col("product") == left, F.col("source_sha"))).alias("l"),
        F.max(F.when(F.col("product") == right, F.col("source_sha"))).alias("r"),
        *[F.coalesce(F.max(F.when(F.col("product") == p, F.col("path"))) == F.lit(path), F.lit(False)).alias(f"p{i}")
          for i, (p, path) in enumerate((expected_paths or {}).items())])
    paths = F.lit(True)
    for i in range(len(expected_paths or {})):
        paths = paths & F.col(f"p{i}")
    same = F.coalesce(F.col("l") == F.col("r"), F.lit(False))
    return one.select(same.alias("same_source"), paths.alias("paths_ok"), (same & paths).alias("allowed"))
