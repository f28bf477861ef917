"""Finding people, places, periods and codes."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from prosopo.catalog import Catalog
from prosopo.operators.aggregates import union_all
from prosopo.operators.filters import Ids, by_places, persons_by_keyword
from prosopo.operators.joins import id_set, of_ids
from prosopo.operators.ordering import first_rows
from prosopo.operators.paging import Pages, paged
from prosopo.plans.profile import basic
from prosopo.plans.relations import PERSONS


def search(catalog: Catalog, keyword: str | None = None, limit: int | None = None, offset: int = 0,
           cap: int | None = None) -> DataFrame:
    """People by id or name: every hit, unsorted, or a page of ``limit`` rows from ``offset`` in id order."""
    alt = catalog["ALTNAME_DATA"] if "ALTNAME_DATA" in catalog else None
    hits = persons_by_keyword(catalog[PERSONS], alt, keyword)
    if limit is None and not offset:
        return basic(catalog, hits)
    hits = first_rows(hits, [F.asc("c_personid")], limit, max(0, int(offset)), cap)
    return basic(catalog, hits).orderBy("person_id")


def search_pages(catalog: Catalog, keyword: str | None = None, ranges: int | None = None) -> Pages:
    """The hits of a search, written once in ranges of their id; :func:`search_page` gives any page of them."""
    alt = catalog["ALTNAME_DATA"] if "ALTNAME_DATA" in catalog else None
    return paged(persons_by_keyword(catalog[PERSONS], alt, keyword), [F.asc("c_personid")], ranges=ranges)


def search_page(catalog: Catalog, hits: Pages, limit: int | None, offset: int = 0) -> DataFrame:
    """A page as :func:`search` gives it; labels are joined to its rows only."""
    return basic(catalog, hits.page(limit, offset)).orderBy("person_id")


def people_by_ids(catalog: Catalog, ids: DataFrame) -> DataFrame:
    return basic(catalog, of_ids(catalog[PERSONS], id_set(ids), "c_personid"))


def dynasty_lookup(catalog: Catalog) -> DataFrame:
    return catalog["DYNASTIES"].select(
        F.col("c_dy").alias("dynasty_id"), F.col("c_dynasty").alias("name"), F.col("c_dynasty_chn").alias("name_chn"),
        F.col("c_start").alias("start_year"), F.col("c_end").alias("end_year"))


def place_lookup(catalog: Catalog) -> DataFrame:
    return catalog["ADDR_CODES"].select(
        F.col("c_addr_id").alias("place_id"), F.col("c_name").alias("name"), F.col("c_name_chn").alias("name_chn"),
        F.col("x_coord"), F.col("y_coord"))


def code_picker(codes: DataFrame, fact: DataFrame, code: str, labels: Sequence[str], fact_code: str | None = None) -> DataFrame:
    """All codes with label and number of facts (0 if unused)."""
    used = fact.groupBy(F.col(fact_code or code).alias("__c")).agg(F.count(F.lit(1)).alias("usage"))
    return (codes.select(F.col(code).alias("code"), F.coalesce(*labels).alias("label")).distinct()
            .join(used, F.col("code") == F.col("__c"), "left")
            .select("code", "label", F.coalesce("usage", F.lit(0)).alias("usage")))


PLACE_SOURCES = ("individual", "entry", "status", "office", "institution", "kin", "assoc_person", "assoc_place")


def place_query(catalog: Catalog, places: Ids, sources: Sequence[str] = ("individual",), subordinate: bool = False) -> DataFrame:
    """(person_id, place_id, source): people tied to the places, by which route.

    individual: index place; entry, office, institution, assoc_place: place of such a
    fact; status: index place of a person with a status; kin, assoc_person: index place
    of a kin or associate.
    """
    hierarchy = catalog["ADDR_BELONGS_DATA"] if "ADDR_BELONGS_DATA" in catalog else None
    at_home = by_places(catalog[PERSONS], "c_index_addr_id", places, hierarchy, subordinate).select(
        F.col("c_personid").alias("__p"), F.col("c_index_addr_id").alias("place_id"))

    def own(table: str, column: str) -> DataFrame:
        return by_places(catalog[table], column, places, hierarchy, subordinate).select(
            F.col("c_personid").alias("person_id"), F.col(column).alias("place_id"))

    def through(table: str, column: str) -> DataFrame:
        pairs = catalog[table].select(F.col("c_personid").alias("person_id"), F.col(column).alias("__o")).distinct()
        return pairs.join(at_home, F.col("__o") == F.col("__p")).select("person_id", "place_id")

    make = {
        "individual": lambda: at_home.withColumnRenamed("__p", "person_id"),
        "entry": lambda: own("ENTRY_DATA", "c_entry_addr_id"),
        "status": lambda: at_home.join(catalog["STATUS_DATA"].select(F.col("c_personid").alias("__s")),
                                       F.col("__p") == F.col("__s"), "left_semi").withColumnRenamed("__p", "person_id"),
        "office": lambda: own("POSTED_TO_ADDR_DATA", "c_addr_id"),
        "institution": lambda: own("BIOG_INST_DATA", "c_inst_addr_id"),
        "kin": lambda: through("KIN_DATA", "c_kin_id"),
        "assoc_person": lambda: through("ASSOC_DATA", "c_assoc_id"),
        "assoc_place": lambda: own("ASSOC_DATA", "c_addr_id"),
    }
    unknown = [s for s in sources if s not in make]
    if unknown:
        raise NotImplementedError(f"unknown place sources {unknown}; one of {PLACE_SOURCES}")
    return union_all([make[s]().where("place_id is not null")
                      .select(F.col("person_id").cast("bigint").alias("person_id"), F.col("place_id").cast("bigint").alias("place_id"))
                      .distinct().withColumn("source", F.lit(s)) for s in sources])


def health(catalog: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]]) -> DataFrame:
    """(table, column, status) for each required column: ok, missing column or missing table.

    Metadata only: no data is read.
    """
    rows = []
    for table in sorted(required):
        have = set(catalog[table].columns) if table in catalog else None
        for column in required[table]:
            status = "missing table" if have is None else "ok" if column in have else "missing column"
            rows.append((table, column, status))
    spark = next(iter(catalog.values())).sparkSession
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in ("table", "column", "status")]))
