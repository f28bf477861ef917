"""Counts and roll-ups; every one combines partial results before its shuffle."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prosopo.operators.joins import of_ids
from prosopo.session import cut_lineage


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows), alphabetical; a table without rows is listed with 0."""
    return union_all([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows")
                      for n, df in tables.items()]).orderBy("table")


# fixed values: result column -> counted table
RELATION_COUNTS = {
    "address_count": "BIOG_ADDR_DATA",
    "alt_name_count": "ALTNAME_DATA",
    "kin_count": "KIN_DATA",
    "assoc_count": "ASSOC_DATA",
    "office_count": "POSTED_TO_OFFICE_DATA",
    "entry_count": "ENTRY_DATA",
    "event_count": "EVENTS_DATA",
    "status_count": "STATUS_DATA",
    "text_count": "BIOG_TEXT_DATA",
    "possession_count": "POSSESSION_DATA",
    "source_count": "BIOG_SOURCE_DATA",
    "institution_count": "BIOG_INST_DATA",
}


def relation_counts(catalog: Mapping[str, DataFrame], persons: DataFrame, key: str = "c_personid") -> DataFrame:
    """Rows per person in each of the twelve fact tables; 0 where there are none.

    The facts are stacked as (person, table) and counted in one aggregation, so there
    is one shuffle, of at most one pre-summed row per person and map task.
    """
    facts = [catalog[t].select(F.col(key).cast("bigint").alias("person_id"), F.lit(n).alias("relation"))
             for n, t in RELATION_COUNTS.items() if t in catalog]
    ids = persons.select(F.col(key).cast("bigint").alias("person_id")).distinct()
    if not facts:
        return ids.select("person_id", *[F.lit(0).cast("bigint").alias(n) for n in RELATION_COUNTS])
    counts = union_all(facts).groupBy("person_id").agg(
        *[F.count_if(F.col("relation") == n).alias(n) for n in RELATION_COUNTS])
    return ids.join(counts, "person_id", "left").select(
        "person_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in RELATION_COUNTS])


def dynasty_bracket(dynasties: DataFrame, ids: DataFrame | Sequence[int] | None = None) -> DataFrame:
    """Smallest and largest dynasty id and year bound of the given dynasties; no row if none exists."""
    rows = dynasties
    if isinstance(ids, DataFrame):
        rows = of_ids(rows, ids, "c_dy")
    elif ids is not None:
        rows = rows.where(F.col("c_dy").isin(list(ids)))
    return (rows.agg(F.min("c_dy").alias("from_dynasty"), F.max("c_dy").alias("to_dynasty"),
                     F.coalesce(F.min("c_start"), F.lit(0)).alias("dynasty_begin"),
                     F.coalesce(F.max("c_end"), F.lit(0)).alias("dynasty_end"))
            .where(F.col("from_dynasty").isNotNull()))


def histogram(df: DataFrame, column: str, name: str = "rows") -> DataFrame:
    """Rows per value; NULL is a value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def top_codes(fact: DataFrame, code: str, person: str, n: int) -> DataFrame:
    """The n codes with most distinct people; ties by code."""
    return (fact.groupBy(code).agg(F.countDistinct(person).alias("people")).where(F.col(code).isNotNull())
            .orderBy(F.desc("people"), F.asc(code)).limit(n))


def top_codes_pruned(fact: DataFrame, code: str, person: str, n: int, lg: int = 12, sigmas: float = 6.0) -> DataFrame:
    """The rows of :func:`top_codes`, where only codes that can be among the first n have their people counted exactly.

    One pass gives each code its rows and a mergeable sketch of its people (``2 ** lg`` registers at most, few for rare codes), combined
    before the shuffle. The n codes with the highest estimates are counted; a code whose upper bound - its rows, or its estimate
    and ``sigmas`` standard errors if that is less - lies below the least of their counts is left out. The bound by rows always holds, that by the sketch but for
    one code in a thousand million at six errors. Persons of codes left out are not shuffled; ties at the threshold are counted.
    """
    error = sigmas * 1.04 / 2 ** (lg / 2)
    if error >= 1:
        raise ValueError("lg is too small for so many standard errors")
    facts = fact.where(F.col(code).isNotNull()).select(F.col(code).alias("__c"), F.col(person).cast("string").alias("__p"))
    estimate = F.hll_sketch_estimate("__s")
    bounds = cut_lineage(facts.groupBy("__c").agg(F.count("__p").alias("__rows"), F.hll_sketch_agg("__p", F.lit(lg)).alias("__s"))
                         .select("__c", estimate.alias("__likely"), F.least("__rows", F.ceil(estimate / (1 - error))).alias("__most")), "code-bounds")

    def counted(codes: DataFrame) -> DataFrame:
        people = facts.join(codes.select("__c"), "__c", "left_semi").groupBy("__c").agg(F.countDistinct("__p").alias("people"))
        return cut_lineage(people, "code-counts")

    leaders = counted(bounds.orderBy(F.desc("__likely"), F.asc("__c")).limit(n))
    least = leaders.agg(F.count(F.lit(1)).alias("codes"), F.min("people").alias("people")).first()
    others = bounds.where(F.col("__most") >= (least["people"] if least["codes"] == n else 0)).join(leaders, "__c", "left_anti")
    return (leaders.unionByName(counted(others)).select(F.col("__c").alias(code), "people")
            .orderBy(F.desc("people"), F.asc(code)).limit(n))


def code_by_dynasty(fact: DataFrame, person: DataFrame, code: str, n: int, key: str = "c_personid") -> DataFrame:
    """The n (code, dynasty) pairs with most distinct people.

    People are reduced to distinct (code, person) before the join, so a hot person is
    joined once per code.
    """
    people = person.select(key, "c_dy")
    return (fact.where(F.col(code).isNotNull()).select(code, key).distinct().join(people, key)
            .groupBy(code, "c_dy").agg(F.count(F.lit(1)).alias("people"))
            .orderBy(F.desc("people"), F.asc(code), F.asc_nulls_first("c_dy")).limit(n))


def year_histogram(df: DataFrame, year: str, width: int) -> DataFrame:
    """Rows per bin of ``width`` years, labelled by the first year; NULL years form their own bin."""
    start = (F.floor(F.col(year) / F.lit(width)) * width).cast("int")
    return df.groupBy(start.alias("bin_start")).agg(F.count(F.lit(1)).alias("rows"))


def frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of each value combination with all subtotals (``level`` tells which are rolled up)."""
    return df.cube(*columns).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("rows"))


def cross_tab(df: DataFrame, row: str, column: str, values: Sequence[object]) -> DataFrame:
    """Counts of ``row`` by stated values of ``column``; ``other`` takes the rest, so rows sum up."""
    known = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.groupBy(row).agg(
        *[F.count_if(F.col(column) == F.lit(v)).alias(f"{column}_{v}") for v in values],
        F.count_if(~known).alias("other"))


def place_counts(rows: DataFrame, place: str, places: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(__place, xy_count) per place with coordinates: how many of the rows lie on those coordinates.

    Rows are counted per place first, so a crowded place is one row from there on.
    """
    spots = places.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(key).alias("__place"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    used = rows.groupBy(F.col(place).alias("__place")).agg(F.count(F.lit(1)).alias("__n")).join(spots, "__place")
    shared = used.groupBy("__x", "__y").agg(F.sum("__n").alias("xy_count"))
    return used.join(shared, ["__x", "__y"]).select("__place", "xy_count")
