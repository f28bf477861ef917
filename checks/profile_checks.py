"""Person profiles: Spark query and oracle side by side."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.code_checks import select_list
from checks.standins import catalog, with_standins
from prosopo.functions import exprs
from prosopo.operators import aggregates as ag, joins, ordering
from prosopo.plans import profile
from prosopo.plans.relations import ACCESSORS, DETAIL, KIN, POSTING

QUERIES = {}
ORACLES = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def nulls(columns):
    return ", ".join(f"f.{c} NULLS FIRST" for c in columns)


def accessor_sql(category: str, given: dict[str, str], joined: str = "", keep: int | None = None, where: str = "true") -> str:
    r = ACCESSORS[category]
    outer = "" if keep is None else f" WHERE ordinal <= {keep}"
    return with_standins(f"""
        SELECT * FROM (
        SELECT f.c_personid AS owner_id, row_number() OVER (PARTITION BY f.c_personid ORDER BY {nulls((*r.order, *r.ties))}) AS ordinal,
               {select_list(r.fields, given)}
        FROM {r.table} f {joined} WHERE {where}){outer}""")


PLACE = "LEFT JOIN ADDR_CODES a ON a.c_addr_id = f.c_addr_id"
SOURCE = "LEFT JOIN TEXT_CODES t ON t.c_textid = f.c_source"
GIVEN = {
    "addresses": ({"sequence": "coalesce(f.c_sequence, 0)", "natal": "f.c_natal = 1", "address_name_chn": "a.c_name_chn",
                   "address_name": "a.c_name", "first_year": "f.c_firstyear", "addr_type_code": "f.c_addr_type", "addr_id": "f.c_addr_id"}, PLACE),
    "altnames": ({"sequence": "coalesce(f.c_sequence, 0)", "alt_name_chn": "f.c_alt_name_chn", "alt_name": "f.c_alt_name",
                  "source": "coalesce(t.c_title_chn, t.c_title)", "name_type_code": "f.c_alt_name_type_code", "source_id": "f.c_source"}, SOURCE),
    "writings": ({"text_id": "f.c_textid", "title_chn": "t.c_title_chn", "title": "t.c_title",
                  "role": "coalesce(r.c_role_desc_chn, r.c_role_desc)", "year": "f.c_year", "pages": "f.c_pages", "role_id": "f.c_role_id"},
                 "LEFT JOIN TEXT_CODES t ON t.c_textid = f.c_textid LEFT JOIN TEXT_ROLE_CODES r ON r.c_role_id = f.c_role_id"),
    "entries": ({"sequence": "coalesce(f.c_sequence, 0)", "entry_method": "coalesce(c.c_entry_desc_chn, c.c_entry_desc)",
                 "exam_rank": "f.c_exam_rank", "year": "f.c_year", "nianhao": "coalesce(nh.c_nianhao_chn, nh.c_nianhao_pin)",
                 "kinship": "coalesce(kc.c_kinrel_chn, kc.c_kinrel)", "kin_name_chn": "kp.c_name_chn", "kin_name": "kp.c_name",
                 "entry_address_chn": "a.c_name_chn", "entry_address": "a.c_name", "entry_code": "f.c_entry_code"},
                """LEFT JOIN ENTRY_CODES c ON c.c_entry_code = f.c_entry_code LEFT JOIN NIAN_HAO nh ON nh.c_nianhao_id = f.c_nianhao_id
                   LEFT JOIN KINSHIP_CODES kc ON kc.c_kincode = f.c_kin_code LEFT JOIN BIOG_MAIN kp ON kp.c_personid = f.c_kin_id
                   LEFT JOIN ADDR_CODES a ON a.c_addr_id = f.c_entry_addr_id"""),
    "statuses": ({"sequence": "coalesce(f.c_sequence, 0)", "status": "coalesce(c.c_status_desc_chn, c.c_status_desc)",
                  "first_year": "f.c_firstyear", "first_nianhao": "coalesce(nh.c_nianhao_chn, nh.c_nianhao_pin)",
                  "source": "coalesce(t.c_title_chn, t.c_title)", "status_code": "f.c_status_code"},
                 f"""LEFT JOIN STATUS_CODES c ON c.c_status_code = f.c_status_code
                     LEFT JOIN NIAN_HAO nh ON nh.c_nianhao_id = f.c_fy_nh_code {SOURCE}"""),
    "possessions": ({"record_id": "f.c_possession_row_id", "possession": "f.c_possession_desc",
                     "address_name_chn": "a.c_name_chn", "address_name": "a.c_name"}, PLACE),
    "events": ({"sequence": "coalesce(f.c_sequence, 0)", "event_name": "coalesce(c.c_event_name_chn, c.c_event_name)", "year": "f.c_year",
                "address_name_chn": "a.c_name_chn", "address_name": "a.c_name", "event_text": "f.c_event", "event_code": "f.c_event_code"},
               f"LEFT JOIN EVENT_CODES c ON c.c_event_code = f.c_event_code {PLACE}"),
    "associations": ({"sequence": "coalesce(f.c_sequence, 0)", "associate_person_id": "f.c_assoc_id", "associate_name_chn": "ap.c_name_chn",
                      "associate_name": "ap.c_name", "association": "coalesce(c.c_assoc_desc_chn, c.c_assoc_desc)",
                      "address_name_chn": "a.c_name_chn", "address_name": "a.c_name", "year": "f.c_assoc_first_year",
                      "text_title": "f.c_text_title", "assoc_code": "f.c_assoc_code"},
                     f"""LEFT JOIN BIOG_MAIN ap ON ap.c_personid = f.c_assoc_id LEFT JOIN ASSOC_CODES c ON c.c_assoc_code = f.c_assoc_code {PLACE}"""),
    "sources": ({"title_chn": "t.c_title_chn", "title": "t.c_title", "pages": "f.c_pages", "main_source": "f.c_main_source = 1",
                 "text_id": "f.c_textid"}, "LEFT JOIN TEXT_CODES t ON t.c_textid = f.c_textid"),
    "institutions": ({"institution_name_chn": "n.c_inst_name_hz", "institution_name": "n.c_inst_name_py", "begin_year": "f.c_bi_begin_year",
                      "place_name_chn": "a.c_name_chn", "place_name": "a.c_name", "x_coord": "a.x_coord", "y_coord": "a.y_coord",
                      "inst_name_code": "f.c_inst_name_code", "inst_code": "f.c_inst_code"},
                     """LEFT JOIN SOCIAL_INSTITUTION_NAME_CODES n ON n.c_inst_name_code = f.c_inst_name_code
                        LEFT JOIN ADDR_CODES a ON a.c_addr_id = f.c_inst_addr_id"""),
}
for _category, (_given, _joined) in GIVEN.items():
    add(f"person_{_category}", lambda s, d, k=_category: profile.accessor(catalog(s, d), k), accessor_sql(_category, _given, _joined))

add("person_entries_of_ids",
    lambda s, d: profile.accessor(catalog(s, d), "entries", catalog(s, d)["BIOG_INST_DATA"].select("c_personid")),
    accessor_sql("entries", *GIVEN["entries"], where="f.c_personid IN (SELECT c_personid FROM BIOG_INST_DATA)"))
for _category in ("addresses", "events", "altnames"):
    add(f"related_{_category}", lambda s, d, k=_category: profile.related_items(catalog(s, d), k, None, 5),
        accessor_sql(_category, *GIVEN[_category], keep=5))

KIN_SQL = """
    SELECT f.c_personid AS owner_id, row_number() OVER (PARTITION BY f.c_personid ORDER BY f.c_kin_id NULLS FIRST, f.c_kin_code) AS ordinal,
    {columns} FROM KIN_DATA f {how} JOIN BIOG_MAIN k ON k.c_personid = f.c_kin_id LEFT JOIN KINSHIP_CODES c ON c.c_kincode = f.c_kin_code"""
_kin = select_list(KIN, {
    "kin_person_id": "f.c_kin_id",
    "kinship": "CASE WHEN c.c_kinrel_chn IS NULL AND c.c_kinrel IS NULL THEN NULL ELSE concat_ws(' ', c.c_kinrel_chn, c.c_kinrel) END",
    "kin_name_chn": "k.c_name_chn", "kin_name": "k.c_name", "is_derived": "false", "up_step": "c.c_upstep", "down_step": "c.c_dwnstep",
    "marriage_step": "c.c_marstep", "collateral_step": "c.c_colstep", "kin_code": "f.c_kin_code"})
add("person_kinships", lambda s, d: profile.direct_kin(catalog(s, d)), with_standins(KIN_SQL.format(columns=_kin, how="LEFT")))
add("person_kinships_no_orphans", lambda s, d: profile.direct_kin(catalog(s, d), keep_orphans=False),
    with_standins(KIN_SQL.format(columns=_kin, how="INNER")))

POSTING_SQL = """
    FROM (SELECT f.*, a.c_addr_id FROM POSTED_TO_OFFICE_DATA f LEFT JOIN POSTED_TO_ADDR_DATA a
          ON a.c_posting_id = f.c_posting_id AND a.c_office_id = f.c_office_id AND a.c_personid = f.c_personid) f"""
# ties on the whole order differ in the source only, so the oracle check leaves `ordinal` and that column out
_posting = {"posting_id": "f.c_posting_id", "office_id": "f.c_office_id", "sequence": "coalesce(f.c_sequence, 0)",
            "office_name_chn": "o.c_office_chn", "office_name": "o.c_office_trans", "first_year": "f.c_firstyear", "last_year": "f.c_lastyear",
            "source_title_chn": "t.c_title_chn", "source_title": "t.c_title",
            "addr_id": "f.c_addr_id", "addr_name_chn": "a.c_name_chn", "addr_name": "a.c_name"}
add("person_postings", lambda s, d: profile.postings(catalog(s, d)).drop("ordinal"), with_standins(f"""
    SELECT f.c_personid AS owner_id, {select_list(POSTING.fields, _posting)} {POSTING_SQL}
    LEFT JOIN OFFICE_CODES o ON o.c_office_id = f.c_office_id LEFT JOIN TEXT_CODES t ON t.c_textid = f.c_source
    LEFT JOIN ADDR_CODES a ON a.c_addr_id = f.c_addr_id"""))
add("nested_postings", lambda s, d: profile.nested_postings(catalog(s, d)).select(
        "owner_id", "posting_id", F.size(F.filter("offices", lambda o: o["address_part"] == 0)).alias("offices"),
        F.aggregate("offices", F.lit(0), lambda n, o: n + F.size(o["addresses"])).alias("addresses")),
    with_standins(f"""SELECT c_personid AS owner_id, c_posting_id AS posting_id,
        count(DISTINCT (c_sequence, c_office_id, c_firstyear, c_lastyear)) AS offices, count(c_addr_id) AS addresses {POSTING_SQL} GROUP BY 1, 2"""))
add("flattened_postings", lambda s, d: profile.flatten_postings(profile.nested_postings(catalog(s, d), part_offices=2, part_addresses=1)),
    with_standins(f"""SELECT c_personid AS owner_id, c_posting_id AS posting_id, c_sequence AS sequence, c_office_id AS office_id,
        c_firstyear AS first_year, c_lastyear AS last_year, c_addr_id AS addr_id {POSTING_SQL}"""))

_counts = ", ".join(f"(SELECT count(*) FROM {t} f WHERE f.c_personid = b.c_personid) AS {n}" for n, t in ag.RELATION_COUNTS.items())
add("relation_counts", lambda s, d: ag.relation_counts(catalog(s, d), catalog(s, d)["BIOG_MAIN"]),
    with_standins(f"SELECT b.c_personid AS person_id, {_counts} FROM BIOG_MAIN b"))
add("person_detail", lambda s, d: profile.detail(catalog(s, d), field_columns=("c_surname", "c_dy")).withColumn(
        "fields", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), F.coalesce(f["value"], F.lit("")))), ";")),
    with_standins(f"""SELECT {select_list(DETAIL, {
        "person_id": "b.c_personid", "surname": "b.c_surname", "name": "b.c_name", "name_chn": "b.c_name_chn", "index_year": "b.c_index_year",
        "dynasty": "dy.c_dynasty", "dynasty_chn": "dy.c_dynasty_chn", "birth_year": "b.c_birthyear",
        "gender": "CASE WHEN b.c_female IS NULL THEN 'Unknown' WHEN b.c_female = 1 THEN 'F' ELSE 'M' END",
        "index_address": "ia.c_name", "index_address_chn": "ia.c_name_chn"})}, {_counts},
        'c_surname=' || b.c_surname || ';c_dy=' || b.c_dy AS fields
        FROM BIOG_MAIN b LEFT JOIN DYNASTIES dy ON dy.c_dy = b.c_dy LEFT JOIN ADDR_CODES ia ON ia.c_addr_id = b.c_index_addr_id"""))


def group(s, d):
    c = catalog(s, d)
    parts = profile.group_people(c, c["BIOG_INST_DATA"].select("c_personid"), include_status=True, include_office=True,
                                 include_entry=True, include_texts=True, include_addresses=True, address_mode=profile.INDEX_ADDRESSES)
    return profile.stacked(parts).groupBy("category", "owner_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("sequence", F.lit(0)).cast("bigint")).alias("sequences"))


add("group_people", group, with_standins("""
    , g AS (SELECT DISTINCT c_personid AS p FROM BIOG_INST_DATA)
    SELECT category, owner_id, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS sequences FROM (
      SELECT 'status' AS category, c_personid AS owner_id, coalesce(c_sequence, 0) AS seq FROM STATUS_DATA
      UNION ALL SELECT 'entry', c_personid, coalesce(c_sequence, 0) FROM ENTRY_DATA
      UNION ALL SELECT 'texts', c_personid, 0 FROM BIOG_TEXT_DATA
      UNION ALL SELECT 'office', f.c_personid, coalesce(f.c_sequence, 0) FROM POSTED_TO_OFFICE_DATA f LEFT JOIN POSTED_TO_ADDR_DATA a
                ON a.c_posting_id = f.c_posting_id AND a.c_office_id = f.c_office_id AND a.c_personid = f.c_personid
      UNION ALL SELECT 'addresses', a.c_personid, coalesce(a.c_sequence, 0) FROM BIOG_ADDR_DATA a
                JOIN BIOG_MAIN b ON b.c_personid = a.c_personid AND b.c_index_addr_id = a.c_addr_id)
    WHERE owner_id IN (SELECT p FROM g) GROUP BY 1, 2"""))

add("zip_by_position",
    lambda s, d: joins.zip_by_position(
        catalog(s, d)["ALTNAME_DATA"].select("c_personid", "c_sequence", "c_alt_name_chn", "c_source"),
        catalog(s, d)["ALTNAME_DATA"], ["c_personid"],
        ordering.nulls_first("c_sequence", "c_alt_name_chn", "c_source"), ordering.nulls_first("c_sequence", "c_alt_name_chn", "c_source"),
        attach=["c_alt_name_type_code"], verify=["c_sequence", "c_alt_name_chn"]),
    with_standins("""SELECT c_personid, row_number() OVER (PARTITION BY c_personid ORDER BY c_sequence NULLS FIRST, c_alt_name_chn NULLS FIRST, c_source) AS ordinal,
                     c_sequence, c_alt_name_chn, c_source, c_alt_name_type_code, true AS zip_ok FROM ALTNAME_DATA"""))


def zipped(s, d):
    """The right side lacks some rows, so positions shift and some rows have no partner."""
    alt = catalog(s, d)["ALTNAME_DATA"]
    right = alt.where("c_source is null or c_source % 3 <> 0")
    order = ordering.nulls_first("c_sequence", "c_alt_name_chn", "c_source")
    return joins.zip_by_position(alt.select("c_personid", "c_sequence", "c_alt_name_chn", "c_source"), right, ["c_personid"], order, order,
                                 attach=["c_alt_name_type_code"], verify=["c_sequence", "c_alt_name_chn"])


add("zip_misaligned", zipped, with_standins("""
    , l AS (SELECT *, row_number() OVER (PARTITION BY c_personid ORDER BY c_sequence NULLS FIRST, c_alt_name_chn NULLS FIRST, c_source NULLS FIRST) AS o FROM ALTNAME_DATA),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_personid ORDER BY c_sequence NULLS FIRST, c_alt_name_chn NULLS FIRST, c_source NULLS FIRST) AS o
          FROM ALTNAME_DATA WHERE c_source IS NULL OR c_source % 3 <> 0)
    SELECT l.c_personid, l.o AS ordinal, l.c_sequence, l.c_alt_name_chn, l.c_source, r.c_alt_name_type_code,
      r.o IS NOT NULL AND l.c_sequence IS NOT DISTINCT FROM r.c_sequence AND l.c_alt_name_chn IS NOT DISTINCT FROM r.c_alt_name_chn AS zip_ok
    FROM l LEFT JOIN r ON l.c_personid = r.c_personid AND l.o = r.o"""))


def tied(s, d):
    """Positions in an order full of ties, by both plans; they must not differ."""
    rows = catalog(s, d)["STATUS_DATA"].select("c_status_code", "c_firstyear", "c_sequence", "c_personid")
    order = ordering.nulls_first("c_firstyear")
    one = ordering.with_ordinal(rows, ["c_status_code"], order).withColumn("plan", F.lit("window"))
    return one.unionByName(ordering.with_ordinal(rows, ["c_status_code"], order, large=1).withColumn("plan", F.lit("ranges")))


add("ordinal_with_ties", tied, with_standins("""
    SELECT c_status_code, c_firstyear, c_sequence, c_personid, unnest(['window', 'ranges']) AS plan, ordinal FROM (
      SELECT c_status_code, c_firstyear, c_sequence, c_personid, row_number() OVER (PARTITION BY c_status_code
        ORDER BY c_firstyear NULLS FIRST, c_sequence NULLS FIRST, c_personid NULLS FIRST) AS ordinal FROM STATUS_DATA)"""))
add("position_in_order", lambda s, d: ordering.with_position(
        catalog(s, d)["ENTRY_DATA"].select("c_personid", "c_year", "c_sequence"), ordering.nulls_first("c_year", "c_personid", "c_sequence")),
    with_standins("""SELECT c_personid, c_year, c_sequence, row_number() OVER (ORDER BY c_year NULLS FIRST, c_personid, c_sequence NULLS FIRST) AS position
                     FROM ENTRY_DATA"""))
add("ordinal_with_large_groups", lambda s, d: ordering.with_ordinal(
        catalog(s, d)["STATUS_DATA"].select("c_status_code", "c_firstyear", "c_sequence"), ["c_status_code"],
        ordering.nulls_first("c_firstyear", "c_sequence"), large=1),
    with_standins("""SELECT c_status_code, c_firstyear, c_sequence,
        row_number() OVER (PARTITION BY c_status_code ORDER BY c_firstyear NULLS FIRST, c_sequence) AS ordinal FROM STATUS_DATA"""))
add("first_per_key", lambda s, d: ordering.keep_first(
        catalog(s, d)["POSTED_TO_OFFICE_DATA"].select("c_posting_id", "c_office_id", "c_sequence", "c_personid"), ["c_posting_id", "c_sequence"],
        ordering.nulls_first("c_office_id", "c_personid")),
    with_standins("""SELECT c_posting_id, c_office_id, c_sequence, c_personid FROM POSTED_TO_OFFICE_DATA
        QUALIFY row_number() OVER (PARTITION BY c_posting_id, c_sequence ORDER BY c_office_id, c_personid) = 1"""))
add("last_per_key", lambda s, d: ordering.keep_last(
        catalog(s, d)["POSTED_TO_OFFICE_DATA"].select("c_posting_id", "c_office_id", "c_sequence", "c_personid"), ["c_posting_id", "c_sequence"],
        ["c_office_id", "c_personid"]),
    with_standins("""SELECT c_posting_id, c_office_id, c_sequence, c_personid FROM POSTED_TO_OFFICE_DATA
        QUALIFY row_number() OVER (PARTITION BY c_posting_id, c_sequence ORDER BY c_office_id DESC, c_personid DESC) = 1"""))


def scalars(s, d):
    b = catalog(s, d)["BIOG_MAIN"]
    low, high = exprs.ordered_bound_columns(F.col("c_index_year"), F.lit(1100))
    return b.select(
        "c_personid", exprs.code_text(F.col("c_dy")).alias("code"), exprs.zero_if_null(F.col("c_index_year")).alias("year0"),
        exprs.label(F.col("c_name_chn"), F.col("c_name")).alias("label"),
        exprs.joined_display(F.col("c_name_chn"), F.col("c_surname")).alias("display"), exprs.gender_label(F.col("c_female")).alias("gender"),
        exprs.flag(F.col("c_female")).alias("is_female"), low.alias("low"), high.alias("high"),
        exprs.short_hash(F.col("c_name_chn")).alias("short"), exprs.short_timestamp(F.concat_ws("#", "c_name", "c_name_chn")).alias("stamp"),
        exprs.any_column(b, ["c_nothing", "c_surname"]).alias("resolved"))


add("scalar_expressions", scalars, with_standins("""
    SELECT c_personid, CAST(c_dy AS VARCHAR) AS code, coalesce(c_index_year, 0) AS year0, coalesce(c_name_chn, c_name) AS label,
      concat_ws(' ', c_name_chn, c_surname) AS display,
      CASE WHEN c_female IS NULL THEN 'Unknown' WHEN c_female = 1 THEN 'F' ELSE 'M' END AS gender, c_female = 1 AS is_female,
      least(c_index_year, 1100) AS low, greatest(c_index_year, 1100) AS high, coalesce(substr(c_name_chn, 1, 12), '(none)') AS short,
      substr(concat_ws('#', c_name, c_name_chn), 1, 19) AS stamp, c_surname AS resolved FROM BIOG_MAIN"""))
add("rename_project", lambda s, d: exprs.project(catalog(s, d)["POSTED_TO_OFFICE_DATA"], {
        "person_id": "c_personid", "posting_id": "c_posting_id", "office_code": "c_office_id", "nothing": "c_absent"}),
    with_standins("SELECT c_personid AS person_id, c_posting_id AS posting_id, c_office_id AS office_code, CAST(NULL AS VARCHAR) AS nothing FROM POSTED_TO_OFFICE_DATA"))
add("nan_to_null", lambda s, d: exprs.nan_to_null(catalog(s, d)["ADDR_CODES"].select(
        "c_addr_id", F.when(F.col("x_coord") > 4, F.lit(float("nan"))).otherwise(F.col("x_coord")).alias("x"))),
    with_standins("SELECT c_addr_id, CASE WHEN x_coord > 4 THEN NULL ELSE x_coord END AS x FROM ADDR_CODES"))
