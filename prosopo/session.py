"""Where intermediate tables go, and how a long plan is cut."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("prosopo.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="prosopo-")
    spark.conf.set("prosopo.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/prosopo/{name}-{uuid.uuid4().hex}"


#: under this setting (since Spark 4.1) a query's shuffle files go as it ends, else when the driver happens to collect its garbage
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: under "false" two sides that are dealt by one of their join's keys are joined as they lie
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting ``name`` as ``value`` within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_released(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written within leaves no shuffle files: nothing reads them again, as the written table is read instead."""
    return setting(spark, RELEASE, "true")


def cut_lineage(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's options, and return the written table.

    A table (rather than an RDD checkpoint) keeps column pruning and file
    statistics for the plans that read it again, and survives lost executors.
    """
    path = new_folder(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    """As :func:`cut_lineage`, with the number of rows, counted as they are written."""
    seen = Observation()
    table = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get["n"]


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str = "buckets", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder bucketed by ``keys``, with the writer's options, and return the written table.

    Joins and groupings by the keys read it without an exchange. Nothing is shuffled when writing: a task writes a file
    for each bucket it meets, so rows that come dealt by the keys make a file a bucket. The table is known by its folder only;
    its name leaves the session's catalog at once.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    table = f"prosopo_{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.format("parquet").options(**options).bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def bucket_count(spark: SparkSession, parts: int = 0) -> int:
    """Buckets for tables that hold a share of an input of ``parts`` partitions: no fewer than the session's shuffle partitions."""
    return max(1, min(int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")), max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def bucketed_and_count(df: DataFrame, keys: list[str], buckets: int, name: str = "buckets") -> tuple[DataFrame, int]:
    """As :func:`bucketed`, with the number of rows, counted as they are written."""
    seen = Observation()
    table = bucketed(df.observe(seen, F.count(F.lit(1)).alias("n")), keys, buckets, name)
    return table, seen.get["n"]
