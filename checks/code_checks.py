"""Code queries, lookups and searches: Spark query and oracle side by side."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from checks.standins import catalog, driver_table, with_standins
from prosopo.operators import filters, joins, namesearch, ordering
from prosopo.operators.aggregates import union_all
from prosopo.plans import code_queries as cq, people, request_batch as rb
from prosopo.plans.fields import Field
from prosopo.plans.relations import ACCESSORS, ASSOCIATION, BASIC, ENTRY, OFFICE, STATUS, TEXT

SQL_TYPES = {"bigint": "BIGINT", "int": "INT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "gender": "VARCHAR"}


def select_list(fields: Sequence[Field], given: dict[str, str]) -> str:
    """All columns of a relation: given expressions, NULL for what the stand-ins lack."""
    unknown = set(given) - {f.name for f in fields}
    assert not unknown, unknown
    return ", ".join(
        f"CAST({given[f.name]} AS {SQL_TYPES[f.type]}) AS \"{f.name}\"" if f.name in given
        else (f"CAST(0 AS {SQL_TYPES[f.type]}) AS \"{f.name}\"" if f.default is not None
              else f"CAST(NULL AS {SQL_TYPES[f.type]}) AS \"{f.name}\"")
        for f in fields)


WHO = {
    "person_id": "b.c_personid", "name_chn": "b.c_name_chn", "name": "b.c_name", "index_year": "b.c_index_year",
    "sex": "CASE WHEN b.c_female IS NULL THEN 'Unknown' WHEN b.c_female = 1 THEN 'F' ELSE 'M' END",
    "dynasty": "coalesce(dy.c_dynasty_chn, dy.c_dynasty)", "index_address_id": "b.c_index_addr_id",
}
WHERE_ = {"index_address": "coalesce(ia.c_name_chn, ia.c_name)"}
WHO_JOINS = """JOIN BIOG_MAIN b ON b.c_personid = f.c_personid LEFT JOIN DYNASTIES dy ON dy.c_dy = b.c_dy
               LEFT JOIN ADDR_CODES ia ON ia.c_addr_id = b.c_index_addr_id"""

#: rows at the same coordinates among all matching rows: windows are computed before a LIMIT
XY = "CASE WHEN xa.x_coord IS NULL OR xa.y_coord IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY xa.x_coord, xa.y_coord) END"
ENTRY_COLUMNS = {
    **WHO, **WHERE_, "sequence": "coalesce(f.c_sequence, 0)", "entry_code": "CAST(f.c_entry_code AS VARCHAR)",
    "entry_method": "f.label", "entry_year": "f.c_year", "nianhao": "coalesce(nh.c_nianhao_chn, nh.c_nianhao_pin)",
    "exam_rank": "f.c_exam_rank", "kinship": "coalesce(kc.c_kinrel_chn, kc.c_kinrel)",
    "kin_person": "coalesce(kp.c_name_chn, kp.c_name)", "entry_address_id": "f.c_entry_addr_id",
    "entry_address": "coalesce(ea.c_name_chn, ea.c_name)", "entry_x_coord": "ea.x_coord", "entry_y_coord": "ea.y_coord",
    "entry_xy_count": "f.xy",
}


def entry_sql(where: str = "true", limit: int | None = None, extra: str = "", recursive: bool = False) -> str:
    top = "" if limit is None else f"""ORDER BY coalesce(c.label, ''), f.c_year NULLS FIRST, f.c_personid NULLS FIRST,
        f.c_sequence NULLS FIRST LIMIT {limit}"""
    return with_standins(f"""
        {extra}, hits AS (
          SELECT f.*, c.label, {XY} AS xy FROM ENTRY_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid
          LEFT JOIN ADDR_CODES xa ON xa.c_addr_id = f.c_entry_addr_id
          LEFT JOIN (SELECT c_entry_code, coalesce(c_entry_desc_chn, c_entry_desc) AS label FROM ENTRY_CODES) c
            ON c.c_entry_code = f.c_entry_code
          WHERE {where} {top})
        SELECT {select_list(ENTRY.fields, ENTRY_COLUMNS)} FROM hits f {WHO_JOINS}
        LEFT JOIN NIAN_HAO nh ON nh.c_nianhao_id = f.c_nianhao_id LEFT JOIN KINSHIP_CODES kc ON kc.c_kincode = f.c_kin_code
        LEFT JOIN BIOG_MAIN kp ON kp.c_personid = f.c_kin_id LEFT JOIN ADDR_CODES ea ON ea.c_addr_id = f.c_entry_addr_id""", recursive)


STATUS_COLUMNS = {
    **WHO, **WHERE_, "x_coord": "ia.x_coord", "y_coord": "ia.y_coord", "sequence": "coalesce(f.c_sequence, 0)",
    "status": "f.label", "status_code": "f.c_status_code", "first_year": "f.c_firstyear", "first_nianhao_code": "f.c_fy_nh_code",
    "first_nianhao": "nh.c_nianhao_chn", "first_nianhao_pinyin": "nh.c_nianhao_pin", "source_id": "f.c_source",
    "source": "coalesce(t.c_title_chn, t.c_title)",
}


def status_sql(where: str = "true", limit: int | None = None, extra: str = "", recursive: bool = False) -> str:
    top = "" if limit is None else f"""ORDER BY coalesce(c.label, ''), f.c_personid NULLS FIRST, f.c_sequence NULLS FIRST LIMIT {limit}"""
    return with_standins(f"""
        {extra}, hits AS (
          SELECT f.*, c.label FROM STATUS_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid
          LEFT JOIN (SELECT c_status_code, coalesce(c_status_desc_chn, c_status_desc) AS label FROM STATUS_CODES) c
            ON c.c_status_code = f.c_status_code
          WHERE {where} {top})
        SELECT {select_list(STATUS.fields, STATUS_COLUMNS)} FROM hits f {WHO_JOINS}
        LEFT JOIN NIAN_HAO nh ON nh.c_nianhao_id = f.c_fy_nh_code LEFT JOIN TEXT_CODES t ON t.c_textid = f.c_source""", recursive)


def office_sql(where: str = "true", limit: int | None = None, workflow: str = "none", extra: str = "", recursive: bool = False) -> str:
    top = "" if limit is None else f"""ORDER BY coalesce(label, ''), c_firstyear NULLS FIRST, c_personid NULLS FIRST, c_posting_id NULLS FIRST,
        c_sequence NULLS FIRST, flat.c_addr_id NULLS FIRST LIMIT {limit}"""
    columns = {
        **WHO, **WHERE_, "posting_id": "f.c_posting_id", "sequence": "coalesce(f.c_sequence, 0)",
        "office_code": "f.c_office_id", "office": "f.label", "appointment_code": "f.c_appt_type_code",
        "first_year": "f.c_firstyear", "last_year": "f.c_lastyear", "office_address_id": "f.c_addr_id",
        "office_address": "coalesce(oa.c_name_chn, oa.c_name)", "office_x_coord": "oa.x_coord", "office_y_coord": "oa.y_coord",
        "office_xy_count": "f.xy",
        "source_id": "f.c_source", "source": "coalesce(t.c_title_chn, t.c_title)", "place_workflow": f"'{workflow}'",
        "person_place_match": "true" if workflow in ("person", "both") else "false",
        "office_place_match": "true" if workflow in ("place", "both") else "false",
        "office_place_count": "f.places",
    }
    return with_standins(f"""
        {extra}, sizes AS (SELECT c_posting_id, c_office_id, c_personid, count(*) AS places FROM POSTED_TO_ADDR_DATA GROUP BY ALL),
        flat AS (
          SELECT f.*, a.c_addr_id, coalesce(s.places, 0) AS places, coalesce(o.c_office_chn, o.c_office_trans, o.c_office_pinyin) AS label
          FROM POSTED_TO_OFFICE_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid
          LEFT JOIN POSTED_TO_ADDR_DATA a ON a.c_posting_id = f.c_posting_id AND a.c_office_id = f.c_office_id AND a.c_personid = f.c_personid
          LEFT JOIN sizes s ON s.c_posting_id = f.c_posting_id AND s.c_office_id = f.c_office_id AND s.c_personid = f.c_personid
          LEFT JOIN OFFICE_CODES o ON o.c_office_id = f.c_office_id
          WHERE {where}),
        hits AS (SELECT flat.*, {XY} AS xy FROM flat LEFT JOIN ADDR_CODES xa ON xa.c_addr_id = flat.c_addr_id {top})
        SELECT {select_list(OFFICE.fields, columns)} FROM hits f {WHO_JOINS}
        LEFT JOIN ADDR_CODES oa ON oa.c_addr_id = f.c_addr_id LEFT JOIN TEXT_CODES t ON t.c_textid = f.c_source""", recursive)


DOWN = """, below(id) AS (SELECT CAST({root} AS BIGINT) UNION SELECT h.c_addr_id FROM ADDR_BELONGS_DATA h JOIN below ON h.c_belongs_to = below.id)"""

# a first stand-in CTE always exists, so the extra list may start with a comma
QUERIES = {}
ORACLES = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


add("entry_query_top",
    lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(entry_codes=["1", "3"], limit=200)),
    entry_sql("f.c_entry_code IN (1, 3)", 200))
add("entry_query_all", lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(limit=None)), entry_sql())
add("entry_query_entry_years",
    lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(
        use_entry_year_range=True, entry_year_from=1100, entry_year_to=950, use_index_year_range=True, index_year_from=900,
        index_year_to=900, dynasty_ids=[1], limit=None)),
    entry_sql("f.c_year BETWEEN 950 AND 1100"))
add("entry_query_index_years",
    lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(
        entry_codes=[2], use_index_year_range=True, index_year_from=900, index_year_to=1100, dynasty_ids=[1], limit=None)),
    entry_sql("f.c_entry_code = 2 AND b.c_index_year BETWEEN 900 AND 1100"))
add("entry_query_dynasties",
    lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(dynasty_ids=[1, 3, 77], sort=True)),
    entry_sql("b.c_dy IN (1, 3, 77)"))
add("entry_query_dynasty_frame",
    lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(dynasty_ids=catalog(s, d)["DYNASTIES"].select("c_dy"), limit=None)),
    entry_sql("b.c_dy IN (SELECT c_dy FROM DYNASTIES)"))
add("entry_query_places",
    lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(place_ids=[3, 8], limit=None)),
    entry_sql("f.c_entry_addr_id IN (3, 8)"))
add("entry_query_subordinate",
    lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(place_ids=[102], include_subordinate_units=True, limit=None)),
    entry_sql("f.c_entry_addr_id IN (SELECT id FROM below)", extra=DOWN.format(root=102), recursive=True))
add("entry_query_person_place",
    lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(place_ids=[3, 8], place_of="person", limit=None)),
    entry_sql("b.c_index_addr_id IN (3, 8)"))
add("entry_query_keyword",
    lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(person_keyword="building-", limit=None)),
    entry_sql("lower(coalesce(b.c_name_chn, '')) LIKE '%building-%'"))
# none of the facts, and with the empty list meant the other way all of them
add("entry_query_empty_meaning",
    lambda s, d: cq.entry_query(catalog(s, d), cq.entry_request(on_empty="none")).unionByName(
        cq.entry_query(catalog(s, d), cq.entry_request(on_empty="all"))).groupBy("entry_code").agg(F.count(F.lit(1)).alias("rows")),
    with_standins("""SELECT CAST(f.c_entry_code AS VARCHAR) AS entry_code, count(*) AS rows FROM ENTRY_DATA f
        JOIN BIOG_MAIN b ON b.c_personid = f.c_personid GROUP BY 1"""))
add("office_query_top",
    lambda s, d: cq.office_query(catalog(s, d), cq.office_request(use_index_year_range=True, index_year_from=900, index_year_to=960, limit=10_000)),
    office_sql("b.c_index_year BETWEEN 900 AND 960", 10_000))
add("office_query_all", lambda s, d: cq.office_query(catalog(s, d), cq.office_request(limit=None)), office_sql())
add("office_query_years",
    lambda s, d: cq.office_query(catalog(s, d), cq.office_request(
        use_office_year_range=True, office_year_from=990, office_year_to=986, dynasty_ids=[1, 2], limit=None)),
    office_sql("f.c_firstyear <= 990 AND coalesce(f.c_lastyear, f.c_firstyear) >= 986 AND b.c_dy IN (1, 2)"))
add("office_query_places",
    lambda s, d: cq.office_query(catalog(s, d), cq.office_request(
        person_place_ids=[100], include_subordinate_person_units=True, office_place_ids=[1, 2, 3], limit=None)),
    office_sql("a.c_addr_id IN (1, 2, 3) AND b.c_index_addr_id IN (SELECT id FROM below)", workflow="both",
               extra=DOWN.format(root=100), recursive=True))
add("status_query_top",
    lambda s, d: cq.status_query(catalog(s, d), cq.status_request(status_codes=[2, 4], limit=5000)),
    status_sql("f.c_status_code IN (2, 4)", 5000))
add("status_query_all", lambda s, d: cq.status_query(catalog(s, d), cq.status_request(limit=None)), status_sql())
add("status_query_place_years",
    lambda s, d: cq.status_query(catalog(s, d), cq.status_request(
        status_codes=[2], place_ids=[200], include_subordinate_units=True, use_index_year_range=True, index_year_from=1100,
        index_year_to=900, limit=None)),
    status_sql("f.c_status_code = 2 AND b.c_index_year BETWEEN 900 AND 1100 AND b.c_index_addr_id IN (SELECT id FROM below)",
               extra=DOWN.format(root=200), recursive=True))

add("association_query",
    lambda s, d: cq.association_query(catalog(s, d), cq.CodeRequest(codes=[1, 4], fact_years=(950, 1100), limit=None)),
    with_standins(f"""
        SELECT {select_list(ASSOCIATION.fields, {
            **WHO, **WHERE_, "sequence": "f.c_sequence", "association_code": "f.c_assoc_code", "association": "coalesce(c.c_assoc_desc_chn, c.c_assoc_desc)",
            "associate_person_id": "f.c_assoc_id", "associate_name_chn": "ap.c_name_chn", "associate_name": "ap.c_name",
            "year": "f.c_assoc_first_year", "address_id": "f.c_addr_id", "text_title": "f.c_text_title"})}
        FROM ASSOC_DATA f {WHO_JOINS} LEFT JOIN ASSOC_CODES c ON c.c_assoc_code = f.c_assoc_code
        LEFT JOIN BIOG_MAIN ap ON ap.c_personid = f.c_assoc_id
        WHERE f.c_assoc_code IN (1, 4) AND f.c_assoc_first_year BETWEEN 950 AND 1100"""))
add("text_query",
    lambda s, d: cq.text_query(catalog(s, d), cq.CodeRequest(codes=[0, 2, 3], limit=None)),
    with_standins(f"""
        SELECT {select_list(TEXT.fields, {
            **WHO, "text_id": "f.c_textid", "title": "coalesce(t.c_title_chn, t.c_title)", "category_code": "t.c_bibl_cat_code",
            "role": "coalesce(r.c_role_desc_chn, r.c_role_desc)", "year": "f.c_year", "pages": "f.c_pages"})}
        FROM BIOG_TEXT_DATA f {WHO_JOINS} JOIN TEXT_CODES t ON t.c_textid = f.c_textid JOIN TEXT_ROLE_CODES r ON r.c_role_id = f.c_role_id
        WHERE t.c_bibl_cat_code IN (0, 2, 3)"""))


def merged(s, d):
    c = catalog(s, d)
    one = lambda dy: cq.entry_query(c, cq.entry_request(dynasty_ids=[dy], limit=None))
    return cq.merge_results([one(1), one(3), one(1)], ["person_id", "sequence"],
                            ["entry_method", "entry_year", "person_id", "sequence", "entry_code"]).select(
        "person_id", "sequence", "entry_method", "entry_year")


add("union_of_dynasty_runs", merged, with_standins("""
    , hits AS (SELECT f.c_personid AS person_id, coalesce(f.c_sequence, 0) AS "sequence",
        coalesce(c.c_entry_desc_chn, c.c_entry_desc) AS entry_method, f.c_year AS entry_year, f.c_entry_code
      FROM ENTRY_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid LEFT JOIN ENTRY_CODES c ON c.c_entry_code = f.c_entry_code
      WHERE b.c_dy IN (1, 3)
      QUALIFY row_number() OVER (PARTITION BY f.c_personid, coalesce(f.c_sequence, 0)
        ORDER BY coalesce(c.c_entry_desc_chn, c.c_entry_desc) NULLS FIRST, f.c_year NULLS FIRST, f.c_entry_code NULLS FIRST) = 1)
    SELECT person_id, "sequence", entry_method, entry_year FROM hits
    ORDER BY entry_method NULLS FIRST, entry_year NULLS FIRST, person_id, "sequence\""""))

BASIC_SQL = """SELECT b.c_personid AS person_id, b.c_name_chn AS name_chn, b.c_name AS name_rm, b.c_index_year AS index_year,
               coalesce(a.c_name_chn, a.c_name) AS index_address
               FROM {who} b LEFT JOIN ADDR_CODES a ON a.c_addr_id = b.c_index_addr_id"""
add("person_search_all", lambda s, d: people.search(catalog(s, d), None, limit=None), with_standins(BASIC_SQL.format(who="BIOG_MAIN")))
add("person_search_page", lambda s, d: people.search(catalog(s, d), " ", limit=5000, offset=30),
    with_standins("SELECT * FROM (" + BASIC_SQL.format(who="BIOG_MAIN") + ") ORDER BY person_id LIMIT 5000 OFFSET 30"))


def search_in_pages(s, d):
    """A search read in five pages, with the page's number: together they are the whole."""
    c = catalog(s, d)
    hits = people.search_pages(c, None)
    size = hits.total // 5 + 1
    return union_all([people.search_page(c, hits, size, k * size).withColumn("page", F.lit(k).cast("bigint")) for k in range(5)])


add("person_search_pages", search_in_pages, with_standins(", n AS (" + BASIC_SQL.format(who="BIOG_MAIN") + """)
    SELECT *, (row_number() OVER (ORDER BY person_id) - 1) // ((SELECT count(*) FROM n) // 5 + 1) AS page FROM n"""))
# an underscore is no digit: this is a name, not person 17
add("person_search_underscore", lambda s, d: people.search(catalog(s, d), "1_7").unionByName(people.search(catalog(s, d), "+17")),
    with_standins(BASIC_SQL.format(who="BIOG_MAIN") + " WHERE b.c_personid = 17 OR contains(lower(coalesce(b.c_name, '')), '1_7') OR contains(lower(coalesce(b.c_name_chn, '')), '1_7')"))
add("person_search_id", lambda s, d: people.search(catalog(s, d), "17"),
    with_standins(BASIC_SQL.format(who="BIOG_MAIN") + " WHERE b.c_personid = 17"))
add("person_search_name", lambda s, d: people.search(catalog(s, d), "RED wid", limit=None),
    with_standins(BASIC_SQL.format(who="BIOG_MAIN") + """ WHERE lower(b.c_name) LIKE '%red wid%' OR lower(coalesce(b.c_name_chn, '')) LIKE '%red wid%'
        OR b.c_personid IN (SELECT c_personid FROM ALTNAME_DATA WHERE lower(c_alt_name_chn) LIKE '%red wid%' OR lower(c_alt_name) LIKE '%red wid%')"""))
add("people_by_ids", lambda s, d: people.people_by_ids(catalog(s, d), catalog(s, d)["ALTNAME_DATA"].select("c_personid")),
    with_standins(BASIC_SQL.format(who="BIOG_MAIN") + " WHERE b.c_personid IN (SELECT c_personid FROM ALTNAME_DATA)"))
add("dynasty_lookup", lambda s, d: people.dynasty_lookup(catalog(s, d)),
    with_standins("SELECT c_dy AS dynasty_id, c_dynasty AS name, c_dynasty_chn AS name_chn, c_start AS start_year, c_end AS end_year FROM DYNASTIES"))
add("place_lookup", lambda s, d: people.place_lookup(catalog(s, d)),
    with_standins("SELECT c_addr_id AS place_id, c_name AS name, c_name_chn AS name_chn, x_coord, y_coord FROM ADDR_CODES"))
for kind, codes, fact, code, labels in (
        ("entry", "ENTRY_CODES", "ENTRY_DATA", "c_entry_code", ("c_entry_desc_chn", "c_entry_desc")),
        ("office", "OFFICE_CODES", "POSTED_TO_OFFICE_DATA", "c_office_id", ("c_office_chn", "c_office_trans", "c_office_pinyin")),
        ("status", "STATUS_CODES", "STATUS_DATA", "c_status_code", ("c_status_desc_chn", "c_status_desc"))):
    add(f"code_picker_{kind}",
        lambda s, d, codes=codes, fact=fact, code=code, labels=labels: people.code_picker(catalog(s, d)[codes], catalog(s, d)[fact], code, labels),
        with_standins(f"""SELECT c.{code} AS code, coalesce({', '.join('c.' + l for l in labels)}) AS label, count(f.{code}) AS usage
                          FROM {codes} c LEFT JOIN {fact} f ON f.{code} = c.{code} GROUP BY 1, 2"""))

IN_SET = "IN (3, 8, 11)"
add("place_query",
    lambda s, d: people.place_query(catalog(s, d), [3, 8, 11], people.PLACE_SOURCES),
    with_standins(f"""
    , home AS (SELECT c_personid AS p, c_index_addr_id AS place_id FROM BIOG_MAIN WHERE c_index_addr_id {IN_SET})
    SELECT DISTINCT * FROM (
      SELECT p AS person_id, place_id, 'individual' AS source FROM home
      UNION ALL SELECT c_personid, c_entry_addr_id, 'entry' FROM ENTRY_DATA WHERE c_entry_addr_id {IN_SET}
      UNION ALL SELECT p, place_id, 'status' FROM home WHERE p IN (SELECT c_personid FROM STATUS_DATA)
      UNION ALL SELECT c_personid, c_addr_id, 'office' FROM POSTED_TO_ADDR_DATA WHERE c_addr_id {IN_SET}
      UNION ALL SELECT c_personid, c_inst_addr_id, 'institution' FROM BIOG_INST_DATA WHERE c_inst_addr_id {IN_SET}
      UNION ALL SELECT k.c_personid, home.place_id, 'kin' FROM KIN_DATA k JOIN home ON home.p = k.c_kin_id
      UNION ALL SELECT k.c_personid, home.place_id, 'assoc_person' FROM ASSOC_DATA k JOIN home ON home.p = k.c_assoc_id
      UNION ALL SELECT c_personid, c_addr_id, 'assoc_place' FROM ASSOC_DATA WHERE c_addr_id {IN_SET})"""))


def radius(s, d):
    c = catalog(s, d)
    return filters.by_radius(c["ENTRY_DATA"], "c_entry_addr_id", c["ADDR_CODES"], [3, 20], 1.5).select("c_personid", "c_sequence", "c_entry_addr_id")


add("radius_filter", radius, with_standins("""
    SELECT c_personid, c_sequence, c_entry_addr_id FROM ENTRY_DATA WHERE c_entry_addr_id IN (
      SELECT a.c_addr_id FROM ADDR_CODES a, ADDR_CODES c WHERE c.c_addr_id IN (3, 20)
      AND sqrt((a.x_coord - c.x_coord) ** 2 + (a.y_coord - c.y_coord) ** 2) <= 1.5)"""))
add("dynasty_windows",
    lambda s, d: joins.in_dynasty_window(catalog(s, d)["BIOG_MAIN"].select("c_personid", "c_index_year"), catalog(s, d)["DYNASTIES"], "c_index_year"),
    with_standins("""SELECT b.c_personid, b.c_index_year, y.c_dy AS window_dy, coalesce(y.c_start, 0) AS window_start, coalesce(y.c_end, 0) AS window_end
                     FROM BIOG_MAIN b JOIN DYNASTIES y ON b.c_index_year BETWEEN coalesce(y.c_start, 0) AND coalesce(y.c_end, 0)"""))
add("dynasty_bounds", lambda s, d: joins.dynasty_bounds(catalog(s, d)["DYNASTIES"], catalog(s, d)["BIOG_MAIN"].select("c_dy")),
    with_standins("""SELECT c_dy AS from_dynasty, c_dy AS to_dynasty, coalesce(c_start, 0) AS dynasty_begin, coalesce(c_end, 0) AS dynasty_end
                     FROM DYNASTIES WHERE c_dy IN (SELECT c_dy FROM BIOG_MAIN)"""))
add("orphan_kin", lambda s, d: joins.orphans(catalog(s, d)["KIN_DATA"], catalog(s, d)["BIOG_MAIN"]),
    with_standins("SELECT * FROM KIN_DATA k WHERE NOT EXISTS (SELECT 1 FROM BIOG_MAIN b WHERE b.c_personid = k.c_kin_id)"))
add("most_orphan_kin", lambda s, d: joins.most_orphans(catalog(s, d)["KIN_DATA"], catalog(s, d)["BIOG_MAIN"]),
    with_standins("""SELECT c_personid, count(*) AS orphan_count FROM KIN_DATA k
                     WHERE NOT EXISTS (SELECT 1 FROM BIOG_MAIN b WHERE b.c_personid = k.c_kin_id)
                     GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""))


# ---- many requests at once: the requests are rows made from the data, alike in Spark and DuckDB
MATRIX = """
    SELECT 'code-' || CAST(c_entry_code AS STRING) AS request_id, c_entry_code AS code, CAST(NULL AS INT) AS dy, CAST(NULL AS INT) AS low, CAST(NULL AS INT) AS high, CAST(NULL AS BIGINT) AS place FROM {ENTRY_CODES}
    UNION ALL
    SELECT 'dynasty-' || CAST(c_entry_code AS STRING) || '-' || CAST(c_dy AS STRING), c_entry_code, c_dy, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS BIGINT) FROM {ENTRY_CODES} CROSS JOIN {DYNASTIES}
    UNION ALL
    SELECT 'years-' || CAST(c_entry_code AS STRING) || '-' || CAST(c_dy AS STRING), c_entry_code, CAST(NULL AS INT), coalesce(c_end, 1010), c_start, CAST(NULL AS BIGINT) FROM {ENTRY_CODES} CROSS JOIN {DYNASTIES}
    UNION ALL
    SELECT 'place-' || CAST(c_addr_id AS STRING), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), c_addr_id FROM {ADDR_CODES}"""


def listed(c):
    return F.when(F.col(c).isNull(), F.array().cast("array<bigint>")).otherwise(F.array(F.col(c).cast("bigint")))


def as_requests(df, **given):
    """A frame of requests: the given columns, NULL for all others."""
    types = dict(p.rsplit(" ", 1) for p in rb.REQUEST.split(", "))
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def matrix_requests(s, d):
    c = catalog(s, d)
    names = ("ENTRY_CODES", "DYNASTIES", "ADDR_CODES")
    raw = s.sql(MATRIX.format(**{n: "{" + n + "}" for n in names}), **{n: c[n] for n in names})
    return as_requests(raw, request_id=F.col("request_id"), codes=listed("code"), places=listed("place"), dynasty_ids=listed("dy"), fact_from=F.col("low"), fact_to=F.col("high"))


def request_matrix(s, d):
    """Some ninety requests by code, code and dynasty, code and years, place."""
    return rb.run_requests(catalog(s, d), ENTRY, matrix_requests(s, d)).select(
        "request_id", "person_id", "sequence", "entry_code", "entry_method", "entry_year", "dynasty", "entry_address", "entry_xy_count")


_IN = {n: n for n in ("ENTRY_CODES", "DYNASTIES", "ADDR_CODES")}
add("request_matrix", request_matrix, with_standins(f"""
    , r AS ({MATRIX.format(**_IN)}),
    hits AS (SELECT r.request_id, f.*, b.c_dy, xa.x_coord, xa.y_coord FROM r JOIN ENTRY_DATA f ON (r.code IS NULL OR f.c_entry_code = r.code)
      AND (r.place IS NULL OR f.c_entry_addr_id = r.place) AND (r.low IS NULL OR f.c_year BETWEEN least(r.low, r.high) AND greatest(r.low, r.high))
      JOIN BIOG_MAIN b ON b.c_personid = f.c_personid AND (r.dy IS NULL OR b.c_dy = r.dy) LEFT JOIN ADDR_CODES xa ON xa.c_addr_id = f.c_entry_addr_id)
    SELECT h.request_id, h.c_personid AS person_id, coalesce(h.c_sequence, 0) AS "sequence", CAST(h.c_entry_code AS VARCHAR) AS entry_code,
      coalesce(c.c_entry_desc_chn, c.c_entry_desc) AS entry_method, h.c_year AS entry_year, coalesce(dy.c_dynasty_chn, dy.c_dynasty) AS dynasty,
      coalesce(ea.c_name_chn, ea.c_name) AS entry_address,
      CASE WHEN h.x_coord IS NULL OR h.y_coord IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY h.request_id, h.x_coord, h.y_coord) END AS entry_xy_count
    FROM hits h LEFT JOIN ENTRY_CODES c ON c.c_entry_code = h.c_entry_code LEFT JOIN DYNASTIES dy ON dy.c_dy = h.c_dy
    LEFT JOIN ADDR_CODES ea ON ea.c_addr_id = h.c_entry_addr_id"""))


def request_matrix_top(s, d):
    """The first 50 postings of each dynasty and region: persons by their index place and all units below, one plan for all."""
    c = catalog(s, d)
    raw = s.sql("""SELECT CAST(d.c_dy AS STRING) || '/' || CAST(p.c_belongs_to AS STRING) AS request_id, d.c_dy, p.c_belongs_to
                   FROM {dy} d CROSS JOIN (SELECT DISTINCT c_belongs_to FROM {up}) p""", dy=c["DYNASTIES"], up=c["ADDR_BELONGS_DATA"])
    asked = as_requests(raw, request_id=F.col("request_id"), dynasty_ids=listed("c_dy"), person_places=listed("c_belongs_to"),
                        include_subordinate_person_units=F.lit(True), row_limit=F.lit(50))
    return rb.run_requests(c, OFFICE, asked, ("person_id", "posting_id", "sequence", "office_code", "office", "office_address_id", "office_place_count",
                                              "office_xy_count", "place_workflow")).select(
        "request_id", "person_id", "posting_id", "sequence", "office_code", "office", "office_address_id", "office_place_count", "office_xy_count", "place_workflow")


add("request_matrix_top", request_matrix_top, with_standins("""
    , below(root, id) AS (SELECT DISTINCT c_belongs_to, c_belongs_to FROM ADDR_BELONGS_DATA UNION SELECT b.root, h.c_addr_id FROM below b JOIN ADDR_BELONGS_DATA h ON h.c_belongs_to = b.id),
    sizes AS (SELECT c_posting_id, c_office_id, c_personid, count(*) AS places FROM POSTED_TO_ADDR_DATA GROUP BY ALL),
    hits AS (SELECT CAST(b.c_dy AS VARCHAR) || '/' || CAST(w.root AS VARCHAR) AS request_id, f.*, a.c_addr_id, coalesce(s.places, 0) AS places,
        coalesce(o.c_office_chn, o.c_office_trans, o.c_office_pinyin) AS label, xa.x_coord, xa.y_coord
      FROM POSTED_TO_OFFICE_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid JOIN DYNASTIES d ON d.c_dy = b.c_dy JOIN below w ON w.id = b.c_index_addr_id
      LEFT JOIN POSTED_TO_ADDR_DATA a ON a.c_posting_id = f.c_posting_id AND a.c_office_id = f.c_office_id AND a.c_personid = f.c_personid
      LEFT JOIN sizes s ON s.c_posting_id = f.c_posting_id AND s.c_office_id = f.c_office_id AND s.c_personid = f.c_personid
      LEFT JOIN OFFICE_CODES o ON o.c_office_id = f.c_office_id LEFT JOIN ADDR_CODES xa ON xa.c_addr_id = a.c_addr_id),
    counted AS (SELECT *, CASE WHEN x_coord IS NULL OR y_coord IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY request_id, x_coord, y_coord) END AS xy FROM hits)
    SELECT request_id, c_personid AS person_id, c_posting_id AS posting_id, coalesce(c_sequence, 0) AS "sequence", CAST(c_office_id AS VARCHAR) AS office_code, label AS office,
      c_addr_id AS office_address_id, places AS office_place_count, xy AS office_xy_count, 'person' AS place_workflow FROM counted
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY coalesce(label, ''), c_firstyear NULLS FIRST, c_personid NULLS FIRST, c_posting_id NULLS FIRST,
      c_sequence NULLS FIRST, c_addr_id NULLS FIRST) <= 50""", recursive=True))

#: keywords of one, two and more characters in both cases, whole names, numbers, words of alternative names only, and one that nobody has
WORDS = """
    SELECT DISTINCT keyword FROM (
      SELECT substr(c_name, 1, 1) AS keyword FROM {ADDR_CODES} UNION ALL SELECT lower(substr(c_name, 1, 2)) FROM {ADDR_CODES} UNION ALL SELECT c_name FROM {ADDR_CODES}
      UNION ALL SELECT c_surname FROM {BIOG_MAIN} UNION ALL SELECT lower(substr(c_name_chn, 1, 7)) FROM {BIOG_MAIN} UNION ALL SELECT CAST(c_personid AS STRING) FROM {ALTNAME_DATA}
      UNION ALL SELECT upper(substr(c_alt_name_chn, 1, 4)) FROM {ALTNAME_DATA} UNION ALL SELECT c_alt_name FROM {ALTNAME_DATA} UNION ALL SELECT 'no such name') x
    WHERE trim(keyword) <> ''"""


def person_search_batch(s, d):
    c = catalog(s, d)
    names = ("ADDR_CODES", "BIOG_MAIN", "ALTNAME_DATA")
    words = s.sql(WORDS.format(**{n: "{" + n + "}" for n in names}), **{n: c[n] for n in names})
    return namesearch.persons_by_keywords(c["BIOG_MAIN"], c["ALTNAME_DATA"], words.select(F.col("keyword").alias("keyword_id"), "keyword")).withColumnRenamed("keyword_id", "keyword")


add("person_search_batch", person_search_batch, with_standins(f"""
    , words AS ({WORDS.format(ADDR_CODES="ADDR_CODES", BIOG_MAIN="BIOG_MAIN", ALTNAME_DATA="ALTNAME_DATA")}),
    names AS (SELECT DISTINCT c_personid AS p, lower(n) AS n FROM (SELECT c_personid, c_name AS n FROM BIOG_MAIN UNION ALL SELECT c_personid, c_name_chn FROM BIOG_MAIN
        UNION ALL SELECT c_personid, c_alt_name_chn FROM ALTNAME_DATA UNION ALL SELECT c_personid, c_alt_name FROM ALTNAME_DATA) WHERE n IS NOT NULL AND c_personid IN (SELECT c_personid FROM BIOG_MAIN))
    SELECT DISTINCT keyword, CAST(p AS BIGINT) AS person_id FROM words JOIN names ON contains(n, lower(trim(keyword))) WHERE NOT regexp_full_match(trim(keyword), '[+-]?[0-9]+')
    UNION SELECT keyword, CAST(c_personid AS BIGINT) FROM words JOIN BIOG_MAIN ON regexp_full_match(trim(keyword), '[+-]?[0-9]+') AND c_personid = TRY_CAST(trim(keyword) AS BIGINT)"""))

# ---- windows of any width: one person's window is 100 000 years wide, some have no beginning or no end
WINDOWS = """SELECT c_personid AS window_id, CAST(CASE WHEN c_personid % 11 = 0 THEN NULL WHEN c_personid = 5 THEN -50000 ELSE 900 + c_personid % 300 END AS INT) AS low,
    CAST(CASE WHEN c_personid % 13 = 0 THEN NULL WHEN c_personid = 5 THEN 50000 ELSE 900 + c_personid % 300 + c_personid % 17 - 1 END AS INT) AS high FROM {BIOG_INST_DATA}"""
add("events_in_windows",
    lambda s, d: joins.in_windows(catalog(s, d)["BIOG_TEXT_DATA"].select("c_textid", "c_year"), "c_year", s.sql(WINDOWS, BIOG_INST_DATA=catalog(s, d)["BIOG_INST_DATA"]), "low", "high"),
    with_standins(f""", w AS ({WINDOWS.format(BIOG_INST_DATA="BIOG_INST_DATA")})
        SELECT f.c_textid, f.c_year, w.* FROM BIOG_TEXT_DATA f JOIN w ON f.c_year BETWEEN w.low AND w.high"""))
