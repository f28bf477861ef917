"""Code queries: which facts of a relation carry given codes, places, years, periods.

Entry, office, status, association and text queries are one plan with different
relation descriptions.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from prosopo.catalog import Catalog
from prosopo.operators.aggregates import place_counts
from prosopo.operators.filters import Ids, by_codes, by_ids, by_places, by_years, is_empty, overlaps_years, persons_by_keyword
from prosopo.operators.joins import expand, fan_out, of_ids, of_keys, with_label, with_person
from prosopo.operators.ordering import LARGE_GROUP_ROWS, first_rows, keep_first, large_keys, nulls_first, row_limit
from prosopo.plans.fields import attach
from prosopo.session import ALL_KEYS, cut_lineage, setting
from prosopo.plans.relations import ASSOCIATION, ENTRY, OFFICE, PERSONS, PLACES, STATUS, TEXT, Relation


@dataclass(frozen=True)
class CodeRequest:
    """Filters of a code query; id sets may be lists or DataFrames.

    ``on_empty`` says what an empty code list means. ``places`` apply to the fact's
    own place if ``place_of`` is "fact", else to the person's index place;
    ``person_places`` always apply to the latter. Without ``limit`` all rows
    return, unsorted unless ``sort`` is set; with one the first rows of the relation's order, ties by
    all columns. A limit above ``cap``, if one is named, is an error.
    """
    codes: Ids = ()
    on_empty: str = "all"
    person_keyword: str | None = None
    places: Ids = ()
    place_of: str = "fact"
    include_subordinate_units: bool = False
    person_places: Ids = ()
    include_subordinate_person_units: bool = False
    index_years: tuple[int, int] | None = None
    fact_years: tuple[int, int] | None = None
    dynasty_ids: Ids = ()
    limit: int | None = None
    cap: int | None = None
    sort: bool = False


def _years(use: bool, low: int, high: int) -> tuple[int, int] | None:
    return (low, high) if use else None


def entry_request(*, person_keyword: str | None = None, entry_codes: Ids = (), place_ids: Ids = (),
                  include_subordinate_units: bool = False, use_index_year_range: bool = False,
                  index_year_from: int = 0, index_year_to: int = 0, use_entry_year_range: bool = False,
                  entry_year_from: int = 0, entry_year_to: int = 0, dynasty_ids: Ids = (),
                  limit: int | None = None, **more) -> CodeRequest:
    return CodeRequest(codes=entry_codes, person_keyword=person_keyword, places=place_ids,
                       include_subordinate_units=include_subordinate_units,
                       index_years=_years(use_index_year_range, index_year_from, index_year_to),
                       fact_years=_years(use_entry_year_range, entry_year_from, entry_year_to),
                       dynasty_ids=dynasty_ids, limit=limit, **more)


def office_request(*, person_keyword: str | None = None, office_codes: Ids = (), person_place_ids: Ids = (),
                   include_subordinate_person_units: bool = False, office_place_ids: Ids = (),
                   include_subordinate_office_units: bool = False, use_index_year_range: bool = False,
                   index_year_from: int = 0, index_year_to: int = 0, use_office_year_range: bool = False,
                   office_year_from: int = 0, office_year_to: int = 0, dynasty_ids: Ids = (),
                   limit: int | None = None, **more) -> CodeRequest:
    return CodeRequest(codes=office_codes, person_keyword=person_keyword, person_places=person_place_ids,
                       include_subordinate_person_units=include_subordinate_person_units, places=office_place_ids,
                       include_subordinate_units=include_subordinate_office_units,
                       index_years=_years(use_index_year_range, index_year_from, index_year_to),
                       fact_years=_years(use_office_year_range, office_year_from, office_year_to),
                       dynasty_ids=dynasty_ids, limit=limit, **more)


def status_request(*, person_keyword: str | None = None, status_codes: Ids = (), place_ids: Ids = (),
                   include_subordinate_units: bool = False, use_index_year_range: bool = False,
                   index_year_from: int = 0, index_year_to: int = 0, dynasty_ids: Ids = (),
                   limit: int | None = None, **more) -> CodeRequest:
    return CodeRequest(codes=status_codes, person_keyword=person_keyword, places=place_ids, place_of="person",
                       include_subordinate_units=include_subordinate_units,
                       index_years=_years(use_index_year_range, index_year_from, index_year_to),
                       dynasty_ids=dynasty_ids, limit=limit, **more)


def _check(relation: Relation, request: CodeRequest) -> None:
    """A filter the relation cannot honour is an error, never ignored."""
    problems = []
    if request.place_of not in ("fact", "person"):
        problems.append("place_of")
    if request.fact_years is not None and relation.years is None:
        problems.append("fact_years")
    if not is_empty(request.places) and request.place_of == "fact" and relation.place is None:
        problems.append("places")
    if problems:
        raise NotImplementedError(f"not available for {relation.table}: {problems}")


def _persons(catalog: Catalog, relation: Relation, request: CodeRequest) -> DataFrame:
    """Persons that pass the person-side filters; of the year modes only the first given one
    applies: fact years (where they replace person years), index years, dynasties."""
    hierarchy = catalog.get("ADDR_BELONGS_DATA") if "ADDR_BELONGS_DATA" in catalog else None
    alt = catalog["ALTNAME_DATA"] if "ALTNAME_DATA" in catalog else None
    persons = persons_by_keyword(catalog[PERSONS], alt, request.person_keyword)
    if not (request.fact_years is not None and relation.years_replace_person_years):
        if request.index_years is not None:
            persons = by_years(persons, "c_index_year", request.index_years)
        elif not is_empty(request.dynasty_ids):
            persons = by_ids(persons, "c_dy", request.dynasty_ids)
    persons = by_places(persons, "c_index_addr_id", request.person_places, hierarchy,
                        request.include_subordinate_person_units)
    if request.place_of == "person":
        persons = by_places(persons, "c_index_addr_id", request.places, hierarchy, request.include_subordinate_units)
    return persons


def code_query(catalog: Catalog, relation: Relation, request: CodeRequest) -> DataFrame:
    """Filtered facts with person and label columns.

    With a limit, person and dimension columns are joined to the top rows only, after
    these are known; without one, to all rows in a single pass. A relation that fans out then takes the label before the fan-out, where there are
    fewer rows, and persons after it, so that no person column goes through it; columns that no field needs stay out, and the
    rows that are written (:func:`_needed`) meet small tables only from there on.
    """
    _check(relation, request)
    hierarchy = catalog["ADDR_BELONGS_DATA"] if "ADDR_BELONGS_DATA" in catalog else None
    hits = by_codes(catalog[relation.table], relation.code, request.codes, request.on_empty)
    if request.fact_years is not None:
        first, last = relation.years
        hits = (by_years(hits, first, request.fact_years) if first == last
                else hits.where(overlaps_years(F.col(first), F.col(last), request.fact_years)))
    if relation.fan_out is None and request.place_of == "fact":
        hits = by_places(hits, relation.place, request.places, hierarchy, request.include_subordinate_units)
    persons = _persons(catalog, relation, request)
    limited = request.limit is not None
    late = relation.fan_out is not None and not limited
    if late:
        hits, persons = _needed(relation, request, hits, persons)
        if _persons_filtered(request):
            hits = of_ids(hits, persons.select("c_personid"), "c_personid")
        facts = hits
        if relation.label:
            codes, key, labels = relation.label
            hits = with_label(hits, catalog[codes], relation.code, key, *labels, name="__label")
    else:
        hits = of_ids(hits, persons.select("c_personid"), "c_personid") if limited else with_person(hits, persons)
    if relation.fan_out is not None:
        table, keys, place = relation.fan_out
        right = catalog[table].select(*keys, place)
        if relation.code in keys:
            right = by_codes(right, relation.code, request.codes, request.on_empty)
        if _persons_filtered(request) and "c_personid" in keys:
            right = of_ids(right, persons.select("c_personid"), "c_personid")
        # unless one owns a large share of the rows, dealt by persons, who are joined next: the placed rows need no shuffle of their own
        even = late and "c_personid" in keys and all(large_keys(t, ["c_personid"], LARGE_GROUP_ROWS) is None for t in (facts, right))
        hits = fan_out(hits, right, keys) if limited else expand(hits, right, keys, "__places", by="c_personid" if even else None)
        if request.place_of == "fact":
            hits = by_places(hits, place, request.places, hierarchy, request.include_subordinate_units)
        if late:
            hits = with_person(hits, persons).drop("b_c_personid")
        with setting(catalog.spark, ALL_KEYS, "false"):
            hits = cut_lineage(hits, "placed", compression="zstd")     # the one fan-out: rows and place counts read it
    xy_counts = _xy_counts(catalog, hits, relation.place) if relation.xy_field else None
    if late and xy_counts is not None:
        xy_counts = cut_lineage(xy_counts, "xy-counts")     # written, so that Spark knows their size: all rows would be shuffled to meet them
    if relation.label and not late:
        codes, key, labels = relation.label
        hits = with_label(hits, catalog[codes], relation.code, key, *labels, name="__label")
    by_person, by_fact = not is_empty(request.person_places), not is_empty(request.places)
    workflow = "both" if by_person and by_fact else "person" if by_person else "place" if by_fact else "none"
    hits = hits.withColumns({"__person_place": F.lit(by_person), "__fact_place": F.lit(by_fact), "__workflow": F.lit(workflow)})
    order = [*( [F.coalesce("__label", F.lit("")).asc()] if relation.label else []),
             *[F.col(c).asc_nulls_first() for c in (*relation.order, *relation.ties)],
             *nulls_first(*catalog[relation.table].columns)]
    rows = hits
    if limited:
        rows = hits.orderBy(*order).limit(row_limit(request.limit, request.cap))
        if relation.fan_out is not None:      # matches of the rows that remain
            sizes = of_keys(right, rows, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__places"))
            rows = rows.join(sizes, list(keys), "left").withColumn("__places", F.coalesce("__places", F.lit(0)))
        rows = with_person(rows, persons)
    if xy_counts is not None:
        rows = (rows.join(xy_counts, F.col(relation.place) == F.col("__place"), "left").drop("__place")
                .withColumn("xy_count", F.coalesce("xy_count", F.lit(0))))
    rows, columns = attach(catalog, rows, relation.fields)
    if limited or request.sort:
        rows = rows.orderBy(*order)
    return rows.select(*[columns[f.name].alias(f.name) for f in relation.fields])


def _needed(relation: Relation, request: CodeRequest, facts: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and persons with the columns that keys, fields and orders name; a sort orders by all of the fact's."""
    _, keys, _ = relation.fan_out
    named = {*keys, "c_personid", relation.code, *relation.order, *relation.ties, *(c for f in relation.fields for c in f.columns)}
    if not request.sort:
        facts = facts.select(*[c for c in facts.columns if c in named])
    return facts, persons.select(*[c for c in persons.columns if c == "c_personid" or f"b_{c}" in named])


def _persons_filtered(request: CodeRequest) -> bool:
    return bool((request.person_keyword or "").strip()) or request.index_years is not None or not all(
        map(is_empty, (request.dynasty_ids, request.person_places, request.places if request.place_of == "person" else ())))


def _xy_counts(catalog: Catalog, hits: DataFrame, place: str) -> DataFrame | None:
    """(__place, xy_count): how many matching rows share the place's coordinates, whatever the limit.

    Counted in one narrow pass over the place column, as part of the query's own job.
    """
    if PLACES not in catalog or not {"x_coord", "y_coord"} <= set(catalog[PLACES].columns):
        return None
    return place_counts(hits, place, catalog[PLACES], "c_addr_id", "x_coord", "y_coord")


def entry_query(catalog: Catalog, request: CodeRequest) -> DataFrame:
    return code_query(catalog, ENTRY, request)


def office_query(catalog: Catalog, request: CodeRequest) -> DataFrame:
    return code_query(catalog, OFFICE, request)


def status_query(catalog: Catalog, request: CodeRequest) -> DataFrame:
    return code_query(catalog, STATUS, request)


def association_query(catalog: Catalog, request: CodeRequest) -> DataFrame:
    return code_query(catalog, ASSOCIATION, request)


def text_query(catalog: Catalog, request: CodeRequest) -> DataFrame:
    """(person, text, role) by bibliography category; person, text and role must all exist."""
    texts = catalog["TEXT_CODES"].select(F.col("c_textid").alias("__t"), "c_bibl_cat_code",
                                         F.coalesce("c_title_chn", "c_title").alias("__title"))
    roles = catalog["TEXT_ROLE_CODES"].select(F.col("c_role_id").alias("__r"),
                                              F.coalesce("c_role_desc_chn", "c_role_desc").alias("__role"))
    fact = catalog["BIOG_TEXT_DATA"]
    fact = (fact.join(by_codes(texts, "c_bibl_cat_code", request.codes, request.on_empty), fact["c_textid"] == F.col("__t"))
            .join(roles, F.col("c_role_id") == F.col("__r")).drop("__t", "__r"))
    return code_query(catalog.with_tables(BIOG_TEXT_DATA=fact), TEXT, request)


def merge_results(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str], limit: int | None = None,
                  cap: int | None = None) -> DataFrame:
    """Union of separately computed results: first row per key in ``order``, sorted; all rows or the first ``limit``."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = keep_first(rows, keys, nulls_first(*order))
    return first_rows(rows, nulls_first(*order), limit, cap=cap)
