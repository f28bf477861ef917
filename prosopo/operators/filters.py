"""Row filters. Id sets given as lists become literals; sets given as DataFrames become semi joins."""
from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prosopo.functions.exprs import ordered_bounds
from prosopo.operators.graph import descendants
from prosopo.operators.joins import id_set, of_ids

_WHOLE = re.compile(r"[+-]?[0-9]+")
Ids = Sequence[int] | Sequence[str] | DataFrame | None


def whole_codes(codes: Sequence[int | str]) -> list[int]:
    """Codes may arrive as text but must be integers."""
    texts = [str(c).strip() for c in codes]
    if not all(map(_WHOLE.fullmatch, texts)):
        raise ValueError(f"codes must be integers: {list(codes)!r}")
    return [int(t) for t in texts]


def is_empty(ids: Ids) -> bool:
    """An id DataFrame counts as given, whatever it holds."""
    return ids is None or (not isinstance(ids, DataFrame) and len(ids) == 0)


def by_ids(df: DataFrame, column: str, ids: Ids) -> DataFrame:
    if isinstance(ids, DataFrame):
        return of_ids(df, id_set(ids), column)
    return df.where(F.col(column).isin(whole_codes(ids or [])))


def by_codes(df: DataFrame, column: str, codes: Ids, on_empty: str) -> DataFrame:
    """Code membership. An empty code list means "all" or "none"; the caller must say which."""
    if on_empty not in ("all", "none"):
        raise ValueError("on_empty must be 'all' or 'none'")
    if is_empty(codes):
        return df if on_empty == "all" else df.where(F.lit(False))
    return by_ids(df, column, codes)


def by_years(df: DataFrame, year: str, bounds: tuple[int, int] | None) -> DataFrame:
    """Inclusive year range, bounds in either order; a NULL year is outside every range."""
    if bounds is None:
        return df
    low, high = ordered_bounds(*bounds)
    return df.where(F.col(year).between(low, high))


def overlaps_years(first: Column, last: Column, bounds: tuple[int, int]) -> Column:
    """Interval [first, last] meets the range; a NULL last year means a one-year interval."""
    low, high = ordered_bounds(*bounds)
    return (first <= high) & (F.coalesce(last, first) >= low)


def by_places(df: DataFrame, column: str, places: Ids, hierarchy: DataFrame | None = None,
              subordinate: bool = False) -> DataFrame:
    """Place membership, optionally with every unit below the given places.

    Without places this is no filter, whatever ``subordinate`` says.
    """
    if is_empty(places):
        return df
    if not subordinate:
        return by_ids(df, column, places)
    if hierarchy is None:
        raise ValueError("subordinate units need the place hierarchy")
    return of_ids(df, descendants(hierarchy, places), column)


def by_radius(df: DataFrame, column: str, places: DataFrame, centres: Ids, degrees: float,
              place_key: str = "c_addr_id", x: str = "x_coord", y: str = "y_coord") -> DataFrame:
    """Rows whose place lies within ``degrees`` of any of the centre places.

    Places and centres meet on grid cells whose diagonal is the radius: a place in a centre's own cell is
    near without a comparison, so a crowded cell forms no pairs within itself. Only places in cells
    without a centre are compared with the centres of the cells around, each spot once.
    """
    if degrees <= 0:
        raise ValueError("degrees must be positive")
    side = float(degrees) / math.sqrt(2) * (1 - 1e-9)     # a little less, so that rounding cannot bring a far place in
    cell = lambda c: F.floor(F.col(c) / F.lit(side))
    spots = (places.where(F.col(x).isNotNull() & F.col(y).isNotNull())
             .withColumn("__px", cell(x)).withColumn("__py", cell(y)))
    centre = (by_ids(spots, place_key, centres)
              .select(F.col(x).alias("__cx"), F.col(y).alias("__cy"), F.col("__px").alias("__gx"), F.col("__py").alias("__gy")).distinct())
    own = centre.select("__gx", "__gy").distinct()
    same_cell = (F.col("__px") == F.col("__gx")) & (F.col("__py") == F.col("__gy"))
    inside = spots.join(own, same_cell, "left_semi")
    around = F.array(*[F.lit(d) for d in (-2, -1, 0, 1, 2)])
    reach = (centre.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
             .select("__cx", "__cy", (F.col("__gx") + F.col("__dx")).alias("__gx"), (F.col("__gy") + F.col("__dy")).alias("__gy")))
    outside = spots.join(own, same_cell, "left_anti")
    near = outside.select(x, y, "__px", "__py").distinct().join(
        reach, same_cell & (F.sqrt(F.pow(F.col(x) - F.col("__cx"), 2) + F.pow(F.col(y) - F.col("__cy"), 2)) <= float(degrees)), "left_semi")
    on_spot = near.select(F.col(x).alias("__nx"), F.col(y).alias("__ny"))
    beside = outside.join(on_spot, (F.col(x) == F.col("__nx")) & (F.col(y) == F.col("__ny")), "left_semi")
    return of_ids(df, inside.select(place_key).union(beside.select(place_key)), column)


def persons_by_keyword(person: DataFrame, altname: DataFrame | None, keyword: str | None,
                       key: str = "c_personid", names: Sequence[str] = ("c_name_chn", "c_name"),
                       alt_names: Sequence[str] = ("c_alt_name_chn", "c_alt_name")) -> DataFrame:
    """Person search: blank finds all, an integer finds that id, other text is looked up
    (case-insensitive, anywhere) in main and alternative names; one row per person."""
    if keyword is None or not keyword.strip():
        return person
    keyword = keyword.strip()
    if _WHOLE.fullmatch(keyword):
        return person.where(F.col(key) == int(keyword))

    def hit(df: DataFrame, columns: Sequence[str]) -> Column:
        found = F.lit(False)
        for c in columns:
            if c in df.columns:
                found = found | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(keyword))), F.lit(False))
        return found

    ids = person.where(hit(person, names)).select(key)
    if altname is not None:
        ids = ids.union(altname.where(hit(altname, alt_names)).select(key))
    return of_ids(person, ids.distinct(), key)


def user_tables(names: DataFrame, column: str = "name",
                hidden: Sequence[str] = ("sqlite_%", "msys%")) -> DataFrame:
    """Hide system tables (case-insensitive patterns) and, if the listing has types, views."""
    for pattern in hidden:
        names = names.where(~F.lower(column).like(pattern.replace("_", "\\_")))
    if "type" in names.columns:
        names = names.where(F.lower("type") == "table")
    return names
