"""Relational data about people, on Spark.

Every public function takes DataFrames (or a :class:`~prosopo.catalog.Catalog` of
them) and returns DataFrames.
"""
from prosopo.catalog import Catalog

__all__ = ["Catalog"]
