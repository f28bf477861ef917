"""Result columns described as data: where each comes from and as which type.

A field is either a column of the row being described or a label looked up in a
dimension table. A column or dimension the catalog lacks gives NULL, so the same
description serves schema variants.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from prosopo.functions.exprs import gender_label


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    column: str | tuple[str, ...] = ()   # column, or alternatives of which the first present counts
    dim: str | None = None
    dim_key: str | None = None
    labels: tuple[str, ...] = ()         # dimension columns, first non-NULL counts
    default: object = None

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,) if isinstance(self.column, str) else self.column


def long(name: str, *column: str, default: int | None = None) -> Field:
    return Field(name, "bigint", column, default=default)


def num(name: str, *column: str, default: int | None = None) -> Field:
    return Field(name, "int", column, default=default)


def real(name: str, dim: str, column: str, dim_key: str, label: str) -> Field:
    return Field(name, "double", column, dim, dim_key, (label,))


def text(name: str, *column: str) -> Field:
    return Field(name, "string", column)


def flag(name: str, *column: str) -> Field:
    return Field(name, "boolean", column)


def look(name: str, dim: str, column: str | tuple[str, ...], dim_key: str, *labels: str) -> Field:
    return Field(name, "string", column, dim, dim_key, labels)


def gender(name: str, column: str) -> Field:
    return Field(name, "gender", column)


def _present(have: set[str], f: Field) -> Column | None:
    have = [F.col(c) for c in f.columns if c in have]
    if not have:
        return None
    return have[0] if len(have) == 1 else F.coalesce(*have)


def attach(catalog: Mapping[str, DataFrame], rows: DataFrame, fields: Sequence[Field]) -> tuple[DataFrame, dict[str, Column]]:
    """Join the dimensions the fields need (left, one join per key and dimension) and
    return the rows with an expression per field.

    No broadcast hints: some of these dimensions (persons, texts) grow with the data,
    and Spark broadcasts the others by their measured size.
    """
    stored = set(rows.columns)
    dims = {d: set(catalog[d].columns) for d in {f.dim for f in fields} if d and d in catalog}
    wanted: dict[tuple, list[Field]] = {}
    for f in fields:
        if f.dim in dims and _present(stored, f) is not None and f.dim_key in dims[f.dim]:
            wanted.setdefault((f.columns, f.dim, f.dim_key), []).append(f)
    out: dict[str, Column] = {}
    for i, ((columns, dim, dim_key), group) in enumerate(wanted.items()):
        names = sorted({c for f in group for c in f.labels if c in dims[dim]})
        side = catalog[dim].select(F.col(dim_key).alias(f"__k{i}"), *[F.col(c).alias(f"__d{i}_{c}") for c in names])
        rows = rows.join(side, _present(stored, group[0]) == F.col(f"__k{i}"), "left")
        for f in group:
            found = [F.col(f"__d{i}_{c}") for c in f.labels if c in names]
            out[f.name] = (F.coalesce(*found) if found else F.lit(None)).cast(f.type)
    for f in fields:
        if f.name in out:
            continue
        here = None if f.dim else _present(stored, f)
        if f.type == "gender":
            out[f.name] = gender_label(here if here is not None else F.lit(None).cast("int"))
            continue
        c = F.lit(None).cast(f.type) if here is None else here.cast(f.type)
        out[f.name] = c if f.default is None else F.coalesce(c, F.lit(f.default).cast(f.type))
    return rows, out


def describe(catalog: Mapping[str, DataFrame], rows: DataFrame, fields: Sequence[Field],
             extra: Sequence[str] = ()) -> DataFrame:
    rows, columns = attach(catalog, rows, fields)
    return rows.select(*[columns[f.name].alias(f.name) for f in fields], *extra)
