"""Many reports in one table, which survive a rewrite that ends half-way.

``rows`` is partitioned by query and slot, ``manifest`` gets a row for each report that is done. A report is written into the slot that its
last complete run does not use - Spark replaces just that partition - and counts only once its manifest row, written last, names the
run. Until then, and for ever if the run is lost, readers see the run before it whole. So a report takes the room of two runs at most. One report is written
to a store at a time.
"""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from prosopo.operators.reconcile import BUCKETS
from prosopo.plans.report import COUNTERS, dashboard

MANIFEST = ("query_id string, run string, slot int, seq bigint, request string, datadump_sha string, generated_at string, "
            + ", ".join(f"{c} bigint" for c in COUNTERS) + ", matches boolean")
ROWS = T.StructType([T.StructField("run", T.StringType()), T.StructField("key", T.MapType(T.StringType(), T.StringType())), T.StructField("bucket", T.StringType()),
                     T.StructField("differing", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("field", "left", "right")]))),
                     T.StructField("query_id", T.StringType()), T.StructField("slot", T.IntegerType())])


def _table(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """A table of the store, empty if nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, store: str) -> DataFrame:
    """The manifest row of each query's last complete run."""
    rows = _table(spark, f"{store}/manifest", MANIFEST)
    return rows.groupBy("query_id").agg(F.max_by(F.struct(*rows.columns), "seq").alias("m")).select("m.*")


def store_rows(result: DataFrame, store: str, query_id: str, run: str, slot: int, every_row: bool = False) -> dict[str, int]:
    """First half of :func:`store_report`: replaces the slot's rows; keys per bucket, counted on the way."""
    keys = [c for c in result.columns if c not in ("bucket", "differing", "left_row", "right_row")]
    seen = Observation()
    rows = result.observe(seen, *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    if not every_row:
        rows = rows.where("bucket <> 'match'")
    key = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(f"`{k}`").cast("string"))])
    (rows.select(F.lit(run).alias("run"), key.alias("key"), "bucket", "differing", F.lit(query_id).alias("query_id"), F.lit(slot).alias("slot"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("query_id", "slot").parquet(f"{store}/rows"))
    return seen.get


def store_report(result: DataFrame, store: str, query_id: str, request: str = "{}", source_sha: str | None = None, every_row: bool = False) -> None:
    """Stores a diff as the report of ``query_id``: its rows that do not match (``every_row``: all) and its counters.

    An earlier report of the query is replaced once this one is whole. The diff is computed once.
    """
    spark = result.sparkSession
    last = committed(spark, store).where(F.col("query_id") == query_id).select("slot", "seq").first()
    slot, seq, run = (1 - last["slot"], last["seq"] + 1, uuid.uuid4().hex) if last else (0, 1, uuid.uuid4().hex)
    n = store_rows(result, store, query_id, run, slot, every_row)
    both = n["match"] + n["mismatch"]
    counters = (both + n["only_left"], both + n["only_right"], n["match"], n["only_left"], n["only_right"], n["mismatch"])
    row = spark.createDataFrame([(query_id, run, slot, seq, request, source_sha, None, *counters, sum(counters[3:]) == 0)], MANIFEST)
    (row.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).coalesce(1).write.mode("append").parquet(f"{store}/manifest"))


def report_rows(spark: SparkSession, store: str, query_id: str | None = None) -> DataFrame:
    """(query_id, key, bucket, differing) of the complete reports, or of one."""
    runs, rows = committed(spark, store).select("query_id", "slot", "run"), _table(spark, f"{store}/rows", ROWS)
    if query_id is not None:
        runs, rows = (d.where(F.col("query_id") == query_id) for d in (runs, rows))
    # a report without rows replaces no partition: rows of another run in its slot are not its own
    return rows.join(runs, ["query_id", "slot", "run"], "left_semi").select("query_id", "key", "bucket", "differing")


def store_dashboard(spark: SparkSession, store: str) -> DataFrame:
    """One line for each complete report, as :func:`prosopo.plans.report.dashboard`."""
    return dashboard(committed(spark, store))
