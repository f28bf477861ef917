"""Reports over comparisons: what was compared, what differed, how many pass."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from prosopo.functions.exprs import short_hash, short_timestamp
from prosopo.operators.reconcile import BUCKETS, in_key_order
from prosopo.session import cut_lineage

COUNTERS = ("rows_left", "rows_right", "rows_matching", "rows_only_left", "rows_only_right", "rows_mismatch")


def write_report(result: DataFrame, folder: str, query_id: str, request: str = "{}", source_sha: str | None = None,
                 keys: Sequence[str] = (), every_row: bool = False) -> DataFrame:
    """Store a diff under ``folder/<query_id>``: ``rows`` (Parquet: all that do not match, or with
    ``every_row`` all; a diff made ``with_rows`` brings both sides' rows along) and ``stats`` (one JSON line).
    With ``keys`` the rows are in report order, by the text of the key. Both are overwritten; anything else in the folder,
    such as an analyst's notes, is left alone. The diff is computed once: its counters
    are taken from the rows on their way to the file.
    """
    spark = result.sparkSession
    seen = Observation()
    stored = result.observe(seen, *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    if not every_row:
        stored = stored.where("bucket <> 'match'")
    ((in_key_order(cut_lineage(stored, "report"), keys) if keys else stored).write.mode("overwrite").parquet(f"{folder}/{query_id}/rows"))
    n = seen.get
    both = n["match"] + n["mismatch"]
    counters = (both + n["only_left"], both + n["only_right"], n["match"], n["only_left"], n["only_right"], n["mismatch"])
    stats = spark.createDataFrame(
        [(query_id, source_sha, request, (*counters, n["mismatch"] + n["only_left"] + n["only_right"] == 0))],
        "query_id string, datadump_sha string, request string, stats struct<"
        + ", ".join(f"{c}: bigint" for c in COUNTERS) + ", matches: boolean>")
    stats = stats.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    stats.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{query_id}/stats")
    return stats


def read_reports(spark: SparkSession, pattern: str, left: str = "left", right: str = "right") -> DataFrame:
    """Stored statistics, one row per query; files that do not parse or lack ``stats`` are left out.

    ``pattern`` names the files, e.g. ``reports/*/stats`` (direct children only). ``left`` and
    ``right`` are the side names used in the stored counter names.
    """
    names = {"rows_left": f"rows_{left}", "rows_right": f"rows_{right}", "rows_matching": "rows_matching",
             "rows_only_left": f"rows_only_in_{left}" if left != "left" else "rows_only_left",
             "rows_only_right": f"rows_only_in_{right}" if right != "right" else "rows_only_right",
             "rows_mismatch": "rows_value_mismatch" if left != "left" else "rows_mismatch"}
    fields = ", ".join(f"`{n}`: bigint" for n in names.values())
    schema = (f"query_id string, generated_at string, datadump_sha string, "
              f"stats struct<{fields}, matches: boolean>, _bad string")
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(
        pattern, multiLine=True)
    return rows.where("_bad is null and stats is not null").select(
        "query_id", F.coalesce("stats.matches", F.lit(False)).alias("matches"),
        *[F.coalesce(f"stats.{stored}", F.lit(0)).alias(n) for n, stored in names.items()],
        F.coalesce("generated_at", F.lit("")).alias("generated_at"), "datadump_sha")


def dashboard(reports: DataFrame) -> DataFrame:
    """One line per query, sorted: verdict, counters, short source hash and time."""
    return reports.select(
        "query_id", F.when(F.col("matches"), "PASS").otherwise("FAIL").alias("verdict"), *COUNTERS,
        short_hash(F.col("datadump_sha")).alias("source"), short_timestamp(F.col("generated_at")).alias("generated")).orderBy("query_id")


def totals(reports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total, passing, failing - with subtotals where ``by`` names categories."""
    grouped = reports.rollup(*by) if by else reports.groupBy()
    n, good = F.count(F.lit(1)), F.count_if("matches")
    return grouped.agg(n.alias("total"), good.alias("passing"), (n - good).alias("failing"))
