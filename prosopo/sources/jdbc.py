"""Reading the tables of a live database."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from prosopo.catalog import Catalog

FETCH_ROWS = 10_000  # fixed value: rows per fetch


def table_options(url: str, table: str, split: tuple[str, int, int, int] | None = None,
                  properties: Mapping[str, str] | None = None) -> dict[str, str]:
    """Reader options for one table; ``split`` is (numeric column, lower, upper, tasks)."""
    options = {"url": url, "dbtable": table, "fetchsize": str(FETCH_ROWS), **(properties or {})}
    if split:
        column, low, high, tasks = split
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(tasks)}
    return options


def listing_query(schema: str) -> str:
    """Base tables with their columns in ordinal order, from the database's own catalog."""
    name = schema.replace("'", "''")
    return ("(select c.table_name, c.column_name, c.column_type, c.ordinal_position "
            "from information_schema.columns c join information_schema.tables t "
            "on t.table_schema = c.table_schema and t.table_name = c.table_name "
            f"where t.table_type = 'BASE TABLE' and t.table_schema = '{name}') as listing")


def list_columns(spark: SparkSession, url: str, schema: str, hidden: Sequence[str] = (),
                 properties: Mapping[str, str] | None = None) -> DataFrame:
    """(table, position, column, mysql_type), alphabetical; ``hidden`` names the provenance table."""
    rows = spark.read.format("jdbc").options(**table_options(url, listing_query(schema), None, properties)).load()
    return (rows.toDF("table", "column", "mysql_type", "position").where(~F.col("table").isin(list(hidden)))
            .select("table", "position", "column", "mysql_type").orderBy("table", "position"))


def read_table(spark: SparkSession, url: str, table: str, split: tuple[str, int, int, int] | None = None,
               properties: Mapping[str, str] | None = None, one_task: bool = False) -> DataFrame:
    """A table, read by the tasks of ``split``. Without a split one task would read it all, which has to be said: ``one_task``."""
    if split is None and not one_task:
        raise ValueError(f"{table}: give a split (column, lower, upper, tasks), or one_task=True for a small table")
    return spark.read.format("jdbc").options(**table_options(url, table, split, properties)).load()


def read_catalog(spark: SparkSession, url: str, schema: str, splits: Mapping[str, tuple[str, int, int, int]] = {}, small: Sequence[str] = (),
                 hidden: Sequence[str] = (), properties: Mapping[str, str] | None = None) -> Catalog:
    """All base tables of a schema as they are typed there; each needs a split or a place in ``small``."""
    names = [r["table"] for r in list_columns(spark, url, schema, hidden, properties).select("table").distinct().collect()]    # one row per table
    return Catalog({t: read_table(spark, url, t, splits.get(t), properties, one_task=t in small) for t in sorted(names)})
