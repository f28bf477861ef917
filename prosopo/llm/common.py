"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from prosopo.session import cut_lineage


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, so that their Python needs no path of the driver's."""
    sc = spark.sparkContext
    if not getattr(sc, "_prosopo_shipped", False):
        package = Path(__file__).resolve().parent.parent
        name = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="prosopo-")), "prosopo-package.zip")
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(name)      # served to executors by the driver
        sc._prosopo_shipped = True
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each Arrow batch with the strings of one column, null as the empty string."""
    for batch in batches:
        yield batch, ["" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component), component the smallest node.

    Alternates two steps until nothing changes: every larger neighbour is hung on the smallest
    neighbour, then every smaller neighbour is. Both are a minimum per node (combined before the
    shuffle) joined back to the edges, so no neighbourhood is ever held in one place; each round is
    written to the shared folder. Loops, nulls and repeated edges are ignored; nodes without an edge
    are not returned. No round drops a link: edges only ever move to smaller nodes of the same component.
    Whether a round is needed shows in a count per node, which is cheaper than a round that changes nothing.
    """
    def settled(e: DataFrame) -> bool:
        """Whether every larger node has one edge and no smaller node hangs on another: stars, each on its smallest node."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count()

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    current = (edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    current = cut_lineage(current, name)
    for _ in range(rounds):
        if settled(current):
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        # large step: neighbours above a node go to its smallest neighbour
        ring = both(current)
        large = (ring.join(least(ring), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small step: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        current = cut_lineage(small, name)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def own_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text) of ``docs``: row is a different number for each row - the id, or where ids are null or repeated a written number -
    and a null text is empty. Only these columns go on, so no name of ``docs`` can clash."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if not rows.groupBy("id").count().where("count > 1 or id is null").take(1):
        return rows.select(F.col("id").alias("row"), "id", "text")
    # written once: a second evaluation could number them otherwise
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "own-rows")
