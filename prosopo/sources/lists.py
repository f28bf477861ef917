"""Code and place lists as files; exports of results as node, edge and map tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from prosopo.session import cut_lineage


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes from a tab-separated list (first field; other lines are an error)."""
    first = F.trim(F.split("value", "\t")[0])
    return spark.read.text(path).where(F.trim("value") != "").select(first.cast("bigint").alias("code")).distinct()


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Place ids from a comma-separated list."""
    return (spark.read.text(path).select(F.explode(F.split("value", ",")).alias("v")).where(F.trim("v") != "")
            .select(F.trim("v").cast("bigint").alias("c_addr_id")).distinct())


def selected_codes(codes: DataFrame, selection: DataFrame, key: str, desc: str, desc_native: str) -> DataFrame:
    wanted = selection.select(F.col(selection.columns[0]).alias("__c"))
    return codes.join(wanted, F.col(key) == F.col("__c"), "left_semi").select(
        F.col(key).alias("code"), F.col(desc).alias("desc"), F.col(desc_native).alias("desc_chn"))


def write_codes(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=False)


def graph_tables(rows: DataFrame, person: Sequence[str], code: Sequence[str], place: Sequence[str],
                 edge: Sequence[str]) -> dict[str, DataFrame]:
    """A query result as people, codes, places (nodes, one row each) and person-code edges.

    The result is written once and the four tables read from it. Nodes are distinct over their
    own columns, so a person with many facts is reduced on the map side.
    """
    rows = cut_lineage(rows.select(*dict.fromkeys([*person, *code, *place, *edge])), "graph-rows")

    def nodes(columns: Sequence[str]) -> DataFrame:
        return rows.select(*columns).where(F.col(columns[0]).isNotNull()).distinct()
    return {"people": nodes(person), "codes": nodes(code), "places": nodes(place), "edges": rows.select(*edge)}


def write_graph(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def map_table(rows: DataFrame, places: DataFrame, place: str) -> DataFrame:
    """Result rows with the coordinates of their place; rows without a place keep NULLs."""
    spots = places.select(F.col("c_addr_id").alias("__p"), F.col("x_coord").alias("x"), F.col("y_coord").alias("y"))
    return rows.join(spots, F.col(place) == F.col("__p"), "left").drop("__p")


def write_map(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)
