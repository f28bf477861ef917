"""Many code queries as one plan: requests are rows, facts are read once.

A request is found through its most telling filter: each of its codes, else each of its places (as facts or persons carry
them), else each of its dynasties, else it is met by every fact. These keys are the inverted index of the requests. A fact, joined to its
place and person once, asks for the keys it holds, of the kinds that some request uses; what meets is tested for the request's other
filters, which are columns or set tables. So hundreds of requests share the scan, the fan-out and the person and label joins, and
every request gives exactly the rows that it gives alone.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from prosopo.catalog import Catalog
from prosopo.functions.exprs import ordered_bounds
from prosopo.operators.aggregates import union_all
from prosopo.operators.filters import whole_codes
from prosopo.operators.graph import descendants
from prosopo.operators.joins import expand, of_ids, with_label, with_person
from prosopo.operators.namesearch import persons_by_keywords
from prosopo.operators.ordering import nulls_first, total_order
from prosopo.plans.code_queries import CodeRequest
from prosopo.plans.fields import attach
from prosopo.plans.relations import PERSONS, PLACES, Relation
from prosopo.session import cut_lineage

#: the columns of a table of requests; lists may be NULL or empty, years are NULL where they do not apply
REQUEST = ("request_id string, codes array<bigint>, on_empty string, person_keyword string, places array<bigint>, place_of string, "
           "include_subordinate_units boolean, person_places array<bigint>, include_subordinate_person_units boolean, "
           "index_from bigint, index_to bigint, fact_from bigint, fact_to bigint, dynasty_ids array<bigint>, row_limit bigint")
NAMES = tuple(p.split()[0] for p in REQUEST.split(", "))
_KINDS = ("code", "place", "person_place", "dynasty", "all")


def request_rows(spark: SparkSession, requests: Mapping[str, CodeRequest]) -> DataFrame:
    """Requests as a table. Id sets must be lists; those given as DataFrames belong to single queries."""
    def ids(x) -> list[int]:
        if isinstance(x, DataFrame):
            raise TypeError("id sets of requests in a table must be lists")
        return whole_codes(x or [])

    rows = []
    for name, r in requests.items():
        index, fact = (ordered_bounds(*b) if b is not None else (None, None) for b in (r.index_years, r.fact_years))
        if r.cap is not None and r.limit is not None and r.limit > r.cap:
            raise ValueError(f"{name}: limit {r.limit} is above the cap of {r.cap}")
        rows.append((name, ids(r.codes), r.on_empty, r.person_keyword, ids(r.places), r.place_of, r.include_subordinate_units, ids(r.person_places),
                     r.include_subordinate_person_units, *index, *fact, ids(r.dynasty_ids), None if r.limit is None else max(1, int(r.limit))))
    return spark.createDataFrame(rows, REQUEST)


def _given(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def _prepared(requests: DataFrame, relation: Relation) -> DataFrame:
    """Requests with plain flags; what the relation cannot honour is an error, as in single queries."""
    missing = [n for n in NAMES if n not in requests.columns]
    if missing:
        raise ValueError(f"a table of requests lacks {missing}")
    r = requests.select(*NAMES).withColumn("place_of", F.coalesce("place_of", F.lit("fact"))).withColumn("on_empty", F.coalesce("on_empty", F.lit("all")))
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    r = r.withColumns({f"{k}_{end}": f(F.col(f"{k}_from"), F.col(f"{k}_to")) for k in ("index", "fact") for end, f in (("low", low), ("high", high))})
    replaced = F.col("fact_low").isNotNull() & F.lit(relation.years_replace_person_years)
    at_person, at_fact = _given("places") & (F.col("place_of") == "person"), _given("places") & (F.col("place_of") == "fact")
    r = r.withColumns({
        "use_index": F.col("index_low").isNotNull() & ~replaced,
        "use_dynasty": _given("dynasty_ids") & F.col("index_low").isNull() & ~replaced,
        "use_fact": F.col("fact_low").isNotNull(), "at_fact": at_fact, "at_person": at_person, "at_home": _given("person_places"),
        "use_keyword": F.coalesce(F.trim("person_keyword") != "", F.lit(False)), "none": ~_given("codes") & (F.col("on_empty") == "none")})
    r = cut_lineage(r, "requests")
    odd = []
    if r.where(~F.col("place_of").isin("fact", "person") | ~F.col("on_empty").isin("all", "none")).take(1):
        odd.append("place_of or on_empty")
    if r.groupBy("request_id").count().where("count > 1 or request_id is null").take(1):
        odd.append("request_id, which must be unique")
    if relation.years is None and r.where("use_fact").take(1):
        odd.append("fact_years")
    if relation.place is None and r.where("at_fact").take(1):
        odd.append("places")
    if odd:
        raise NotImplementedError(f"not available for {relation.table}: {odd}")
    return r


def _place_sets(requests: DataFrame, catalog: Catalog) -> DataFrame:
    """(rid, side, place) of every place a request accepts, units below included where it says so; side is fact, person or home."""
    def of(flag: str, column: str, below: str, side: str) -> DataFrame:
        return requests.where(flag).select("request_id", F.explode(column).alias("place"), F.coalesce(below, F.lit(False)).alias("below"), F.lit(side).alias("side"))
    given = cut_lineage(of("at_fact", "places", "include_subordinate_units", "fact")
                        .union(of("at_person", "places", "include_subordinate_units", "person"))
                        .union(of("at_home", "person_places", "include_subordinate_person_units", "home")), "request-places")
    own = given.select(F.col("request_id").alias("rid"), "side", "place")
    if not given.where("below").take(1):
        return own.distinct()
    if "ADDR_BELONGS_DATA" not in catalog:
        raise ValueError("subordinate units need the place hierarchy")
    under = descendants(catalog["ADDR_BELONGS_DATA"], given.where("below").select("place").distinct(), per_root=True)
    wider = given.where("below").join(under, F.col("place") == F.col("root")).select(F.col("request_id").alias("rid"), "side", F.col("id").alias("place"))
    return own.union(wider).distinct()


def _index(requests: DataFrame, sets: DataFrame) -> DataFrame:
    """(kind, value, rid): each request by its most telling filter."""
    kind = (F.when(_given("codes"), "code").when(F.col("at_fact"), "place").when(F.col("at_person") | F.col("at_home"), "person_place")
            .when(F.col("use_dynasty"), "dynasty").otherwise("all"))
    keyed = requests.where(~F.col("none")).select(F.col("request_id").alias("rid"), kind.alias("kind"), "codes", "dynasty_ids", "at_person")
    exploded = lambda k, c: keyed.where(F.col("kind") == k).select("kind", F.explode(c).alias("value"), "rid")
    by_set = keyed.where(F.col("kind").isin("place", "person_place")).join(sets, "rid").where(
        F.col("side") == F.when(F.col("kind") == "place", "fact").when(F.col("at_person"), "person").otherwise("home")).select("kind", F.col("place").alias("value"), "rid")
    every = keyed.where("kind = 'all'").select("kind", F.lit(0).cast("bigint").alias("value"), "rid")
    return exploded("code", "codes").union(exploded("dynasty", "dynasty_ids")).union(by_set).union(every).distinct()


#: kinds of keys that persons carry, by column; the columns of persons that requests test
_HELD = {"person_place": "c_index_addr_id", "dynasty": "c_dy"}
_TESTED = ("c_personid", "c_index_year", "c_dy", "c_index_addr_id")


def _asked_persons(persons: DataFrame, index: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """The persons whom a request finds, all of which go by this kind, and whose year and dynasty it accepts; each person's rows are judged one by one."""
    tests = asked.select(F.col("request_id").alias("rid"), *(F.col(c).alias(f"__{c}") for c in ("use_index", "index_low", "index_high", "use_dynasty", "dynasty_ids")))
    found = index.join(tests, "rid").drop("kind", "rid").withColumnRenamed("value", "__value")
    year, dynasty = F.col("c_index_year"), F.col("c_dy").cast("bigint")
    ok = ~F.col("__use_index") | F.coalesce(year.between(F.col("__index_low"), F.col("__index_high")), F.lit(False))
    ok &= ~F.col("__use_dynasty") | F.coalesce(F.array_contains("__dynasty_ids", dynasty), F.lit(False))
    return persons.join(found, (F.col(_HELD[kind]).cast("bigint") == F.col("__value")) & ok, "left_semi")


def run_requests(catalog: Catalog, relation: Relation, requests: DataFrame | Mapping[str, CodeRequest], fields: Sequence[str] | None = None) -> DataFrame:
    """request_id and the relation's columns (or those of them named), for every request the rows of its single query, unsorted.

    With a row limit a request's first rows in the relation's order return, ties by all columns. A request without a hit gives no row.
    """
    if not isinstance(requests, DataFrame):
        requests = request_rows(catalog.spark, requests)
    wanted = [f for f in relation.fields if fields is None or f.name in fields]
    if fields is not None and (unknown := set(fields) - {f.name for f in wanted}):
        raise ValueError(f"not fields of {relation.table}: {sorted(unknown)}")
    asked = _prepared(requests, relation)
    sets = cut_lineage(_place_sets(asked, catalog), "request-sets")
    index = cut_lineage(_index(asked, sets), "request-index")
    kinds = [r["kind"] for r in index.select("kind").distinct().collect()]      # of five kinds
    facts = catalog[relation.table]
    if kinds == ["code"]:        # no request without codes: other facts need no join
        facts = of_ids(facts, index.select(F.col("value").alias("id")).distinct(), relation.code)
    persons = catalog[PERSONS]
    if len(kinds) == 1 and kinds[0] in _HELD:       # facts of persons whom no request asks for need no fan-out
        persons = _asked_persons(persons, index, asked, kinds[0])
    needed = {*(c for f in wanted for c in f.columns), *relation.order, *relation.ties, relation.code, relation.place, *(f"b_{c}" for c in _TESTED)}
    hits = with_person(facts, persons.select(*[c for c in persons.columns if f"b_{c}" in needed]))
    if relation.fan_out is not None:
        table, keys, place = relation.fan_out
        hits = expand(hits, catalog[table].select(*keys, place), keys, "__places")
    if relation.label:
        codes, key, labels = relation.label
        hits = with_label(hits, catalog[codes], relation.code, key, *labels, name="__label")
    value = {"code": F.col(relation.code), "place": F.col(relation.place) if relation.place else F.lit(None), "person_place": F.col("b_c_index_addr_id"),
             "dynasty": F.col("b_c_dy"), "all": F.lit(0)}
    holds = F.array(*(F.struct(F.lit(k).alias("kind"), value[k].cast("bigint").alias("value")) for k in kinds))
    met = hits.withColumn("__key", F.explode(holds)).join(
        index.select(F.struct("kind", "value").alias("__key"), F.col("rid").alias("__rid")), "__key").drop("__key")
    tests = asked.select(F.col("request_id").alias("__rid"), *(F.col(c).alias(f"__{c}") for c in (
        "use_index", "index_low", "index_high", "use_dynasty", "dynasty_ids", "use_fact", "fact_low", "fact_high", "at_fact", "at_person", "at_home", "use_keyword", "codes", "row_limit")))
    met = met.join(tests, "__rid").where(_passes(relation))
    for side, flag, column in (("fact", "__at_fact", relation.place), ("person", "__at_person", "b_c_index_addr_id"), ("home", "__at_home", "b_c_index_addr_id")):
        if column is None:
            continue
        ok = sets.where(F.col("side") == side).select(F.col("rid").alias("__srid"), F.col("place").alias("__splace"))
        met = (met.join(ok, (F.col("__rid") == F.col("__srid")) & (F.col(column) == F.col("__splace")), "left")
               .where(~F.col(flag) | F.col("__srid").isNotNull()).drop("__srid", "__splace"))
    if asked.where("use_keyword").take(1):
        alt = catalog["ALTNAME_DATA"] if "ALTNAME_DATA" in catalog else None
        words = asked.where("use_keyword").select(F.col("request_id").alias("keyword_id"), F.col("person_keyword").alias("keyword"))
        who = persons_by_keywords(catalog[PERSONS], alt, words).select(F.col("keyword_id").alias("__krid"), F.col("person_id").alias("__kperson"))
        met = (met.join(who, (F.col("__rid") == F.col("__krid")) & (F.col("c_personid") == F.col("__kperson")), "left")
               .where(~F.col("__use_keyword") | F.col("__krid").isNotNull()).drop("__krid", "__kperson"))
    both = F.col("__at_fact") | F.col("__at_person")
    met = met.withColumns({"__person_place": F.col("__at_home"), "__fact_place": both, "__workflow": F.when(F.col("__at_home") & both, "both")
                           .when(F.col("__at_home"), "person").when(both, "place").otherwise("none")})
    met = cut_lineage(met.drop(*(f"__{c}" for c in ("use_index", "index_low", "index_high", "use_dynasty", "dynasty_ids", "use_fact", "fact_low", "fact_high",
                                                    "at_fact", "at_person", "at_home", "use_keyword", "codes"))), "request-hits")
    rows = _first_rows(catalog, relation, met)
    if relation.xy_field in {f.name for f in wanted} and PLACES in catalog and {"x_coord", "y_coord"} <= set(catalog[PLACES].columns):
        rows = _with_xy(catalog, relation, met, rows)
    rows, columns = attach(catalog, rows, wanted)
    return rows.select(F.col("__rid").alias("request_id"), *[columns[f.name].alias(f.name) for f in wanted])


def _passes(relation: Relation) -> Column:
    """The tests on the request's and the fact's own columns; a NULL passes no test."""
    year = F.col("b_c_index_year")
    ok = ~F.col("__use_index") | F.coalesce(year.between(F.col("__index_low"), F.col("__index_high")), F.lit(False))
    ok &= ~F.col("__use_dynasty") | F.coalesce(F.array_contains("__dynasty_ids", F.col("b_c_dy").cast("bigint")), F.lit(False))
    ok &= ~_given("__codes") | F.coalesce(F.array_contains("__codes", F.col(relation.code).cast("bigint")), F.lit(False))
    if relation.years is not None:
        first, last = (F.col(c) for c in relation.years)
        inside = (first <= F.col("__fact_high")) & (F.coalesce(last, first) >= F.col("__fact_low"))
        ok &= ~F.col("__use_fact") | F.coalesce(inside, F.lit(False))
    return ok


def _first_rows(catalog: Catalog, relation: Relation, met: DataFrame) -> DataFrame:
    """The hits, of requests with a limit the first ones."""
    order = [*([F.coalesce("__label", F.lit("")).asc()] if relation.label else []),
             *[F.col(c).asc_nulls_first() for c in (*relation.order, *relation.ties)], *nulls_first(*catalog[relation.table].columns)]
    most = met.agg(F.max("__row_limit")).first()[0]
    if most is None:
        return met
    n = F.row_number().over(Window.partitionBy("__rid").orderBy(*order))
    limited = met.where("__row_limit is not null").withColumn("__n", n).where((F.col("__n") <= int(most)) & (F.col("__n") <= F.col("__row_limit"))).drop("__n")
    return limited.union(met.where("__row_limit is null"))


def _with_xy(catalog: Catalog, relation: Relation, met: DataFrame, rows: DataFrame) -> DataFrame:
    """xy_count: the request's hits at the same coordinates, whatever its limit; counted a request and place first."""
    spots = catalog[PLACES].where("x_coord is not null and y_coord is not null").select(
        F.col("c_addr_id").alias("__place"), F.col("x_coord").alias("__x"), F.col("y_coord").alias("__y"))
    used = cut_lineage(met.groupBy("__rid", F.col(relation.place).alias("__place")).agg(F.count(F.lit(1)).alias("__n")).join(spots, "__place"), "request-xy")
    shared = used.groupBy("__rid", "__x", "__y").agg(F.sum("__n").alias("xy_count"))
    counts = used.join(shared, ["__rid", "__x", "__y"]).select(F.col("__rid").alias("__xrid"), "__place", "xy_count")
    return (rows.join(counts, (F.col("__rid") == F.col("__xrid")) & (F.col(relation.place) == F.col("__place")), "left").drop("__xrid", "__place")
            .withColumn("xy_count", F.coalesce("xy_count", F.lit(0))))
