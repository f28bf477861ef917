"""Scalar expressions used in projections. All are built-in column functions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def project(df: DataFrame, mapping: Mapping[str, str], types: Mapping[str, str] | None = None) -> DataFrame:
    """Rename and keep: ``{result name: source column}``; an absent source gives NULL."""
    types = types or {}
    have = set(df.columns)
    return df.select(
        *[
            (F.col(src) if src in have else F.lit(None).cast(types.get(dst, "string"))).alias(dst)
            for dst, src in mapping.items()
        ]
    )


def code_text(code: Column) -> Column:
    """Codes are numbers in storage and text in results; NULL stays NULL."""
    return code.cast("string")


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def label(*choices: Column) -> Column:
    """First label that is not NULL. An empty string is a label and is kept."""
    return F.coalesce(*choices)


def joined_display(native: Column, other: Column, separator: str = " ") -> Column:
    """Both labels side by side; one alone if the other is NULL; NULL if both are."""
    return F.when(native.isNotNull() | other.isNotNull(), F.concat_ws(separator, native, other))


def gender_label(female: Column) -> Column:
    return F.when(female.isNull(), "Unknown").when(female.cast("int") == 1, "F").otherwise("M")


def flag(c: Column) -> Column:
    return c.cast("boolean")


def any_column(df: DataFrame, names: Sequence[str]) -> Column:
    """The column a table stores under one of several names (first non-NULL if several)."""
    present = [F.col(n) for n in names if n in df.columns]
    if not present:
        raise ValueError(f"none of the columns {list(names)} is present")
    return present[0] if len(present) == 1 else F.coalesce(*present)


def ordered_bounds(low: int, high: int) -> tuple[int, int]:
    """Year bounds given in either order."""
    return (low, high) if low <= high else (high, low)


def ordered_bound_columns(low: Column, high: Column) -> tuple[Column, Column]:
    return F.least(low, high), F.greatest(low, high)


def short_hash(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 12), F.lit("(none)"))


def short_timestamp(c: Column) -> Column:
    return F.substring(c, 1, 19)
