"""Everything known about given persons, for any number of persons at once.

Single-person accessors become batch queries over an id table. The order a person's
rows have is kept in ``ordinal``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prosopo.catalog import Catalog
from prosopo.functions.exprs import joined_display
from prosopo.operators.aggregates import relation_counts
from prosopo.operators.graph import KinCaps, expand_kinship, kin_edges
from prosopo.operators.joins import expand, id_set, of_ids, with_kin_person
from prosopo.operators.ordering import nulls_first, top_per_key, with_ordinal
from prosopo.plans.fields import Field, attach, describe
from prosopo.plans.relations import ACCESSORS, BASIC, DETAIL, EXPANDED_KIN, KIN, PERSONS, POSTING
from prosopo.session import cut_lineage

CATEGORIES = (*ACCESSORS, "postings", "kinships")


def _facts(catalog: Catalog, table: str, ids: DataFrame | None) -> DataFrame:
    rows = catalog[table]
    return rows if ids is None else of_ids(rows, ids, "c_personid")


def _numbered(rows: DataFrame, order: tuple[str, ...], per_person: int | None) -> DataFrame:
    by = nulls_first(*[c for c in order if c in rows.columns])
    if per_person is None:
        return with_ordinal(rows, ["c_personid"], by, "ordinal")
    return top_per_key(rows, ["c_personid"], by, per_person, "ordinal")


def _finish(catalog: Catalog, rows: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    rows, columns = attach(catalog, rows, fields)
    return rows.select(F.col("c_personid").cast("bigint").alias("owner_id"), "ordinal",
                       *[columns[f.name].alias(f.name) for f in fields])


def accessor(catalog: Catalog, category: str, ids: DataFrame | None = None, per_person: int | None = None) -> DataFrame:
    """Rows of one category for the given persons (all persons if none given):
    owner_id, ordinal, then the category's columns. ``per_person`` keeps each person's first n."""
    return _accessor(catalog, category, None if ids is None else id_set(ids), per_person)


def _accessor(catalog: Catalog, category: str, ids: DataFrame | None, per_person: int | None = None) -> DataFrame:
    if category == "kinships":
        return direct_kin(catalog, ids, per_person=per_person)
    if category == "postings":
        return postings(catalog, ids, per_person=per_person)
    relation = ACCESSORS[category]
    rows = _numbered(_facts(catalog, relation.table, ids), (*relation.order, *relation.ties), per_person)
    return _finish(catalog, rows, relation.fields)


def direct_kin(catalog: Catalog, ids: DataFrame | None = None, keep_orphans: bool = True,
               per_person: int | None = None) -> DataFrame:
    """Direct kin with relation label and step vector, ordered by kin id and code."""
    steps = catalog["KINSHIP_CODES"].select(
        F.col("c_kincode").alias("__code"), joined_display(F.col("c_kinrel_chn"), F.col("c_kinrel")).alias("__kinship"),
        F.col("c_upstep").alias("__up"), F.col("c_dwnstep").alias("__down"), F.col("c_marstep").alias("__mar"),
        F.col("c_colstep").alias("__col"))
    rows = _facts(catalog, "KIN_DATA", ids)
    if not keep_orphans:
        rows = of_ids(rows, catalog[PERSONS].select("c_personid"), "c_kin_id")
    rows = with_kin_person(_numbered(rows, ("c_kin_id", "c_kin_code"), per_person), catalog[PERSONS], keep_orphans)
    rows = rows.join(steps, F.col("c_kin_code") == F.col("__code"), "left").withColumn("__derived", F.lit(False))
    return _finish(catalog, rows, KIN)


def expanded_kin(catalog: Catalog, ids: DataFrame | None = None, caps: KinCaps = KinCaps()) -> DataFrame:
    """Kin of the given persons within the step limits, one row per person and kin, with names.

    A derived relation shows as the chain of its relation labels.
    """
    codes = catalog["KINSHIP_CODES"]
    reached = cut_lineage(expand_kinship(kin_edges(catalog["KIN_DATA"], codes), ids, caps), "kin")
    longest = reached.agg(F.max("hop")).first()[0] or 0
    rows = reached
    for i in range(longest):  # at most one join to the code table per round
        names = codes.select(F.col("c_kincode").alias(f"__c{i}"),
                             joined_display(F.col("c_kinrel_chn"), F.col("c_kinrel")).alias(f"__n{i}"))
        rows = rows.join(names, F.get("path", F.lit(i)) == F.col(f"__c{i}"), "left")
    chain = F.concat_ws(" > ", *[F.col(f"__n{i}") for i in range(longest)]) if longest else F.lit(None).cast("string")
    rows = rows.withColumns({"__kinship": F.nullif(chain, F.lit("")),
                             "__notes": F.when(F.col("is_derived"), F.array_join(F.col("path").cast("array<string>"), "/"))})
    rows = with_kin_person(rows, catalog[PERSONS], kin_key="kin_person_id")
    rows, columns = attach(catalog, rows, EXPANDED_KIN)
    return rows.select(F.col("seed_id").alias("owner_id"), *[columns[f.name].alias(f.name) for f in EXPANDED_KIN])


def _posting_rows(catalog: Catalog, ids: DataFrame | None) -> DataFrame:
    table, keys, place = POSTING.fan_out
    addresses = catalog[table]
    audit = [c for c in ("c_created_by", "c_created_date", "c_modified_by", "c_modified_date") if c in addresses.columns]
    addresses = addresses.select(*keys, place, *[F.col(c).alias(f"addr_{c}") for c in audit])
    if ids is not None and "c_personid" in keys:
        addresses = of_ids(addresses, ids, "c_personid")
    # written once: numbering measures group sizes on narrow columns, then reads the rows
    return cut_lineage(expand(_facts(catalog, POSTING.table, ids), addresses, keys, "__places"), "postings")


def postings(catalog: Catalog, ids: DataFrame | None = None, per_person: int | None = None) -> DataFrame:
    """Flat postings: one row per posting, office and address."""
    return _finish(catalog, _numbered(_posting_rows(catalog, ids), POSTING.order, per_person), POSTING.fields)


def nested_postings(catalog: Catalog, ids: DataFrame | None = None, part_offices: int = 1000, part_addresses: int = 10_000) -> DataFrame:
    """Postings with their offices and the offices' addresses as nested arrays.

    (owner_id, posting_id, part, offices<sequence, office_id, first_year, last_year, address_part,
    addresses>). A posting of more than ``part_offices`` offices continues in further parts, cut between
    offices. An office of more than ``part_addresses`` addresses continues under a further ``address_part``; only
    part 0 stands for the office, so offices are counted by it. No array outgrows these bounds.
    """
    owner = [F.col("c_personid").alias("owner_id"), F.col("c_posting_id").alias("posting_id")]
    office = [F.col("c_sequence").alias("sequence"), F.col("c_office_id").alias("office_id"),
              F.col("c_firstyear").alias("first_year"), F.col("c_lastyear").alias("last_year")]
    names = ["owner_id", "posting_id", "sequence", "office_id", "first_year", "last_year"]
    flat = with_ordinal(_posting_rows(catalog, ids).select(*owner, *office, "c_addr_id"), names, nulls_first("c_addr_id"), "__n")
    offices = flat.groupBy(*names, F.floor((F.col("__n") - 1) / part_addresses).cast("int").alias("address_part")).agg(
        F.array_sort(F.collect_list("c_addr_id")).alias("addresses"))
    offices = with_ordinal(cut_lineage(offices, "offices"), ["owner_id", "posting_id"], nulls_first(*names[2:], "address_part"), "__n")
    return offices.groupBy("owner_id", "posting_id", F.floor((F.col("__n") - 1) / part_offices).cast("int").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(*names[2:], "address_part", "addresses"))).alias("offices"))


def flatten_postings(nested: DataFrame) -> DataFrame:
    """Nested postings back to one row per office and address (NULL where it has none)."""
    return (nested.select("owner_id", "posting_id", F.explode("offices").alias("o"))
            .select("owner_id", "posting_id", "o.sequence", "o.office_id", "o.first_year", "o.last_year",
                    F.explode_outer("o.addresses").alias("addr_id")))


def basic(catalog: Catalog, persons: DataFrame) -> DataFrame:
    return describe(catalog, persons, BASIC)


def detail(catalog: Catalog, ids: DataFrame | None = None, field_columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per known person: names, years, dynasty, index place and twelve counts.

    ``fields`` lists further stored columns as (name, value). An unknown id has no row.
    """
    ids = None if ids is None else id_set(ids)
    persons = catalog[PERSONS] if ids is None else of_ids(catalog[PERSONS], ids, "c_personid")
    extra = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in field_columns]) \
        if field_columns else F.array().cast("array<struct<name:string,value:string>>")
    rows = describe(catalog, persons.withColumn("fields", extra), DETAIL, extra=["fields"])
    counts = relation_counts({t: catalog[t] if ids is None else of_ids(catalog[t], ids, "c_personid")
                              for t in catalog if t != PERSONS and "c_personid" in catalog[t].columns}, persons)
    fields = rows.columns[:-1]
    return rows.join(counts, "person_id").select(*fields, *[c for c in counts.columns if c != "person_id"], "fields")


def related_items(catalog: Catalog, category: str, ids: DataFrame | None, limit: int) -> DataFrame:
    """The first ``limit`` rows of a category for each person."""
    if category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}; one of {CATEGORIES}")
    return accessor(catalog, category, ids, per_person=max(1, limit))


ALL_ADDRESSES, INDEX_ADDRESSES = 1, 2  # fixed values: address modes

_GROUP = {"status": "statuses", "office": "postings", "entry": "entries", "texts": "writings", "addresses": "addresses"}


def group_people(catalog: Catalog, ids: DataFrame, include_status: bool = False, include_office: bool = False,
                 include_entry: bool = False, include_texts: bool = False, include_addresses: bool = False,
                 address_mode: int = ALL_ADDRESSES) -> dict[str, DataFrame]:
    """The asked-for categories for a group of persons; a category not asked for is empty."""
    if address_mode not in (ALL_ADDRESSES, INDEX_ADDRESSES):
        raise ValueError("address_mode must be 1 (all) or 2 (index address only)")
    wanted = {"status": include_status, "office": include_office, "entry": include_entry, "texts": include_texts,
              "addresses": include_addresses}
    ids = id_set(ids)
    out = {}
    for name, category in _GROUP.items():
        if not wanted[name]:
            table = POSTING.table if category == "postings" else ACCESSORS[category].table
            out[name] = _accessor(catalog.with_tables(**{table: catalog[table].limit(0)}), category, None)
            continue
        rows = _accessor(catalog, category, ids)
        if name == "addresses" and address_mode == INDEX_ADDRESSES:
            index = catalog[PERSONS].select(F.col("c_personid").alias("__p"), F.col("c_index_addr_id").alias("__a"))
            rows = rows.join(index, (F.col("owner_id") == F.col("__p")) & (F.col("addr_id") == F.col("__a")), "left_semi")
        out[name] = rows
    return out


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """A group result as one table with ``category``; columns a category lacks are NULL."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("category", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
