"""Pages of one sorted result: written once in ranges of its order, with the rows of each range counted.

A page is found by the counts; only the ranges it meets are read and sorted. So a late page costs what an early one costs, and
reading all pages sorts each range about once.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prosopo.operators.ordering import row_limit, total_order
from prosopo.session import new_folder

_RANGE = "__range"


@dataclass(frozen=True)
class Pages:
    """``rows`` with their range as partition column; ``before``: of each range its number and the rows in front of it, in order; ``total`` rows."""
    rows: DataFrame
    order: tuple[Column, ...]
    before: tuple[tuple[int, int], ...]
    total: int

    def ranges(self, limit: int | None, offset: int) -> list[int]:
        """Numbers of the ranges a page meets."""
        end = self.total if limit is None else offset + row_limit(limit)
        ends = [*(n for _, n in self.before[1:]), self.total]
        return [k for (k, first), last in zip(self.before, ends) if first < end and last > offset]

    def page(self, limit: int | None, offset: int = 0) -> DataFrame:
        """Sorted, from ``offset``, ``limit`` rows or all that follow. Ties are broken by all columns, as everywhere."""
        offset = max(0, int(offset))
        met = self.ranges(limit, offset)
        rows = self.rows.where(F.col(_RANGE).isin(met) if met else F.lit(False)).drop(_RANGE)
        skipped = offset - next((n for k, n in self.before if met and k == met[0]), offset)
        rows = rows.orderBy(*total_order(rows, self.order))
        rows = rows.offset(skipped) if skipped else rows
        return rows if limit is None else rows.limit(row_limit(limit))


def paged(df: DataFrame, order: Sequence[Column], folder: str | None = None, ranges: int | None = None) -> Pages:
    """Writes ``df`` in ``ranges`` ranges of its total order (the session's shuffle partitions by default) and counts them.

    All columns take part in the ranges, so equal order values spread over several. The counts are a number a range, however many rows there are.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "pages")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the range is the task that writes it: what is known of a row's place is known without a second look at it
    (df.repartitionByRange(ranges, *total_order(df, order)).withColumn(_RANGE, F.spark_partition_id())
     .write.mode("overwrite").partitionBy(_RANGE).parquet(folder))
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(_RANGE, T.IntegerType())])).parquet(folder)
    before, total = [], 0
    for r in rows.groupBy(_RANGE).count().orderBy(_RANGE).collect():
        before.append((r[_RANGE], total))
        total += r["count"]
    return Pages(rows, tuple(order), tuple(before), total)
