"""A named set of DataFrames."""
from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession


class Catalog(Mapping[str, DataFrame]):
    """Tables by name; names are case-sensitive."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        if not tables:
            raise ValueError("a catalog needs at least one table")
        self._tables = dict(tables)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, names: list[str]) -> Catalog:
        """Read ``folder/<name>`` for each name (the layout :func:`write_tables` makes)."""
        return cls({n: spark.read.parquet(f"{folder}/{n}") for n in names})

    @property
    def spark(self) -> SparkSession:
        return next(iter(self._tables.values())).sparkSession

    def __getitem__(self, name: str) -> DataFrame:
        try:
            return self._tables[name]
        except KeyError:
            raise KeyError(f"no table {name!r} in the catalog") from None

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def with_tables(self, **tables: DataFrame) -> Catalog:
        return Catalog({**self._tables, **tables})
