"""The person database as seen in the driver's tables.

Each stand-in is one SQL text that Spark and DuckDB both understand: Spark builds the
catalog from it, the oracle queries use it as a common table expression. All rows of
the driver's tables are used; NULLs are made where the driver's data has none.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

from prosopo import Catalog

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "pages", "labels", "conversations")

_ORDER_YEAR = "900 + (extract(year FROM o_orderdate) - 1995) * 50 + extract(month FROM o_orderdate)"
_SHIP_YEAR = "900 + (extract(year FROM l_shipdate) - 1995) * 40 + extract(month FROM l_shipdate)"
_PRIORITY = "CAST(substr(o_orderpriority, 1, 1) AS INT)"
_EVENT = "CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS INT)"
_ROLE = "CAST(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 9 END AS INT)"

STANDINS: dict[str, str] = {
    "BIOG_MAIN": """
        SELECT c_custkey AS c_personid, c_name,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment || '-' || CAST(c_custkey AS STRING) END AS c_name_chn,
               CAST(CASE WHEN c_acctbal < 0 THEN NULL ELSE 900 + c_custkey % 400 END AS INT) AS c_index_year,
               CAST(c_nationkey % 7 AS INT) AS c_dy, CAST(c_nationkey AS BIGINT) AS c_index_addr_id,
               CAST(CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS INT) AS c_female,
               c_mktsegment AS c_surname, CAST(CASE WHEN c_acctbal > 5000 THEN 880 + c_custkey % 400 END AS INT) AS c_birthyear
        FROM {customer}""",
    "ADDR_CODES": """
        SELECT CAST(n_nationkey AS BIGINT) AS c_addr_id, n_name AS c_name,
               CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'P' || n_name END AS c_name_chn,
               CAST(CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_nationkey % 10 END AS DOUBLE) AS x_coord,
               CAST(n_nationkey % 2 AS DOUBLE) AS y_coord
        FROM {nation}
        UNION ALL
        SELECT CAST(100 + r_regionkey AS BIGINT), r_name, r_name, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM {region}
        UNION ALL
        SELECT CAST(200 AS BIGINT), min('all ' || r_name), NULL, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM {region}""",
    "ADDR_BELONGS_DATA": """
        SELECT CAST(n_nationkey AS BIGINT) AS c_addr_id, CAST(100 + n_regionkey AS BIGINT) AS c_belongs_to, CAST(NULL AS INT) AS c_first_year
        FROM {nation}
        UNION ALL
        SELECT CAST(100 + r_regionkey AS BIGINT), CAST(200 AS BIGINT), CAST(NULL AS INT) FROM {region}""",
    "DYNASTIES": """
        SELECT CAST(r_regionkey AS INT) AS c_dy, r_name AS c_dynasty, 'D' || r_name AS c_dynasty_chn,
               CAST(900 + 80 * r_regionkey AS INT) AS c_start,
               CAST(CASE WHEN r_regionkey = 4 THEN NULL ELSE 990 + 80 * r_regionkey END AS INT) AS c_end
        FROM {region}""",
    "NIAN_HAO": """
        SELECT CAST(r_regionkey AS INT) AS c_nianhao_id, CASE WHEN r_regionkey = 2 THEN NULL ELSE 'E' || r_name END AS c_nianhao_chn,
               r_name AS c_nianhao_pin
        FROM {region}""",
    "ENTRY_DATA": f"""
        SELECT o_custkey AS c_personid, {_PRIORITY} AS c_entry_code,
               CAST(CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN NULL ELSE {_ORDER_YEAR} END AS INT) AS c_year,
               CAST(CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE o_orderkey END AS INT) AS c_sequence,
               o_orderstatus AS c_exam_rank,
               CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 25 END AS BIGINT) AS c_entry_addr_id,
               CAST(o_orderkey % 6 AS INT) AS c_nianhao_id, CAST(1 + o_orderkey % 7 AS INT) AS c_kin_code,
               o_custkey + 7 AS c_kin_id
        FROM {{orders}}""",
    "ENTRY_CODES": f"""
        SELECT DISTINCT {_PRIORITY} AS c_entry_code, substr(o_orderpriority, 3) AS c_entry_desc,
               CASE {_PRIORITY} WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'Z' || substr(o_orderpriority, 3) END AS c_entry_desc_chn
        FROM {{orders}}""",
    "POSTED_TO_OFFICE_DATA": f"""
        SELECT l_suppkey AS c_personid, l_orderkey AS c_posting_id, l_partkey AS c_office_id, CAST(l_linenumber AS INT) AS c_sequence,
               CAST({_SHIP_YEAR} AS INT) AS c_firstyear,
               CAST(CASE WHEN l_quantity < 10 THEN NULL ELSE {_SHIP_YEAR} + CAST(l_quantity AS INT) % 7 END AS INT) AS c_lastyear,
               CAST(l_partkey % 50 AS BIGINT) AS c_source, CAST(l_linenumber % 3 AS INT) AS c_appt_type_code
        FROM {{lineitem}}""",
    "POSTED_TO_ADDR_DATA": """
        SELECT l_orderkey AS c_posting_id, l_partkey AS c_office_id, l_suppkey AS c_personid,
               CAST((l_partkey + l_suppkey) % 25 AS BIGINT) AS c_addr_id
        FROM {lineitem} WHERE l_returnflag IN ('R', 'A')
        UNION ALL
        SELECT l_orderkey, l_partkey, l_suppkey, CAST((l_partkey + l_suppkey + 7) % 25 AS BIGINT) FROM {lineitem} WHERE l_returnflag = 'A'
        UNION ALL
        SELECT l_orderkey, l_partkey, l_suppkey, CAST((l_partkey + l_suppkey + 14) % 25 AS BIGINT) FROM {lineitem} WHERE l_returnflag = 'A'""",
    "OFFICE_CODES": """
        SELECT p_partkey AS c_office_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS c_office_chn,
               CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS c_office_trans, p_brand AS c_office_pinyin
        FROM {part}""",
    "STATUS_DATA": f"""
        SELECT user_id AS c_personid, CAST(event_id AS INT) AS c_sequence, {_EVENT} AS c_status_code,
               CAST(floor(value) AS BIGINT) AS c_source, CAST(900 + extract(day FROM ts) AS INT) AS c_firstyear,
               CAST(event_id % 6 AS INT) AS c_fy_nh_code
        FROM {{events}}""",
    "STATUS_CODES": f"""
        SELECT DISTINCT {_EVENT} AS c_status_code, event_type AS c_status_desc,
               CASE {_EVENT} WHEN 1 THEN NULL ELSE 'S' || event_type END AS c_status_desc_chn
        FROM {{events}}""",
    "KIN_DATA": """
        SELECT c_custkey AS c_personid, c_custkey + 40 AS c_kin_id, CAST(1 AS INT) AS c_kin_code FROM {customer}
        UNION ALL
        SELECT c_custkey, c_custkey - 40, CAST(2 AS INT) FROM {customer}
        UNION ALL
        SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey - 1 END, CAST(3 AS INT) FROM {customer}
        UNION ALL
        SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_custkey + 4 END, CAST(4 AS INT) FROM {customer}
        UNION ALL
        SELECT c_custkey, c_custkey + 120, CAST(5 AS INT) FROM {customer}
        UNION ALL
        SELECT c_custkey, c_custkey, CAST(6 AS INT) FROM {customer} WHERE c_mktsegment = 'FURNITURE'""",
    "KINSHIP_CODES": """
        SELECT CAST(r_regionkey + 1 AS INT) AS c_kincode, substr(r_name, 1, 2) AS c_kinrel,
               CASE WHEN r_regionkey = 1 THEN NULL ELSE 'K' || CAST(r_regionkey AS STRING) END AS c_kinrel_chn,
               CAST(CASE r_regionkey WHEN 0 THEN 1 WHEN 4 THEN 3 ELSE 0 END AS INT) AS c_upstep,
               CAST(CASE r_regionkey WHEN 1 THEN 1 ELSE 0 END AS INT) AS c_dwnstep,
               CAST(CASE r_regionkey WHEN 2 THEN 1 WHEN 0 THEN NULL ELSE 0 END AS INT) AS c_marstep,
               CAST(CASE r_regionkey WHEN 3 THEN 1 ELSE 0 END AS INT) AS c_colstep
        FROM {region}""",
    "ASSOC_DATA": f"""
        SELECT o_custkey AS c_personid, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS c_assoc_id, {_PRIORITY} AS c_assoc_code,
               CAST(o_orderkey AS INT) AS c_sequence, CAST({_ORDER_YEAR} AS INT) AS c_assoc_first_year,
               o_orderstatus AS c_text_title, CAST(o_orderkey % 25 AS BIGINT) AS c_addr_id
        FROM {{orders}}""",
    "ASSOC_CODES": f"""
        SELECT DISTINCT {_PRIORITY} AS c_assoc_code, o_orderpriority AS c_assoc_desc,
               CASE WHEN {_PRIORITY} = 3 THEN NULL ELSE 'A' || o_orderpriority END AS c_assoc_desc_chn
        FROM {{orders}}""",
    "ALTNAME_DATA": """
        SELECT CAST(p_size AS BIGINT) AS c_personid, CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 5 END AS INT) AS c_sequence,
               CAST(p_partkey % 4 AS INT) AS c_alt_name_type_code, p_name AS c_alt_name_chn, p_brand AS c_alt_name, p_partkey AS c_source
        FROM {part}""",
    "BIOG_ADDR_DATA": f"""
        SELECT o_custkey AS c_personid, CAST(o_orderkey AS INT) AS c_sequence, {_PRIORITY} AS c_addr_type,
               CAST(o_orderkey % 25 AS BIGINT) AS c_addr_id,
               CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS INT) AS c_natal,
               CAST({_ORDER_YEAR} AS INT) AS c_firstyear
        FROM {{orders}}""",
    "BIOG_TEXT_DATA": f"""
        SELECT doc_id % 150 AS c_personid, doc_id AS c_textid, CAST(CASE WHEN lang = 'fr' THEN NULL ELSE 900 + n_chars % 300 END AS INT) AS c_year,
               {_ROLE} AS c_role_id, source AS c_pages
        FROM {{documents}}""",
    "TEXT_CODES": """
        SELECT doc_id AS c_textid, source || '/' || CAST(doc_id AS STRING) AS c_title, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS c_title_chn,
               CAST(n_chars % 5 AS INT) AS c_bibl_cat_code
        FROM {documents}""",
    "TEXT_ROLE_CODES": f"""
        SELECT DISTINCT {_ROLE} AS c_role_id, 'role ' || lang AS c_role_desc, CAST(NULL AS STRING) AS c_role_desc_chn
        FROM {{documents}} WHERE lang IN ('en', 'de', 'fr')""",
    "BIOG_SOURCE_DATA": """
        SELECT conv_id AS c_personid, turn AS c_textid, role AS c_pages, CAST(CASE WHEN role = 'user' THEN 1 ELSE 0 END AS INT) AS c_main_source
        FROM {conversations}""",
    "BIOG_INST_DATA": """
        SELECT s_suppkey AS c_personid, CAST(CASE WHEN s_acctbal < 0 THEN NULL ELSE 900 + s_nationkey END AS INT) AS c_bi_begin_year,
               CAST(s_nationkey AS INT) AS c_inst_name_code, s_suppkey AS c_inst_code, CAST(s_nationkey AS BIGINT) AS c_inst_addr_id
        FROM {supplier}""",
    "SOCIAL_INSTITUTION_NAME_CODES": """
        SELECT CAST(n_nationkey AS INT) AS c_inst_name_code, 'I' || n_name AS c_inst_name_hz, n_name AS c_inst_name_py FROM {nation}""",
    "EVENTS_DATA": f"""
        SELECT user_id AS c_personid, CAST(CASE WHEN event_type = 'error' THEN NULL ELSE 900 + extract(day FROM ts) END AS INT) AS c_year,
               CAST(event_id AS INT) AS c_sequence, {_EVENT} AS c_event_code, CAST(event_id % 25 AS BIGINT) AS c_addr_id, props AS c_event
        FROM {{events}}""",
    "EVENT_CODES": f"""
        SELECT DISTINCT {_EVENT} AS c_event_code, event_type AS c_event_name, CAST(NULL AS STRING) AS c_event_name_chn FROM {{events}}""",
    "POSSESSION_DATA": """
        SELECT page_id % 40 AS c_personid, page_id AS c_possession_row_id, url AS c_possession_desc, CAST(page_id % 25 AS BIGINT) AS c_addr_id
        FROM {pages}""",
}

_CATALOGS: dict[tuple[int, str], Catalog] = {}


def driver_table(spark: SparkSession, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def catalog(spark: SparkSession, folder: str) -> Catalog:
    key = (id(spark), folder)
    if key not in _CATALOGS:
        raw = {n: driver_table(spark, folder, n) for n in DRIVER_TABLES}
        used = lambda sql: {n: raw[n] for n in raw if "{" + n + "}" in sql}
        _CATALOGS[key] = Catalog({n: spark.sql(sql, **used(sql)) for n, sql in STANDINS.items()})
    return _CATALOGS[key]


def with_standins(query: str, recursive: bool = False) -> str:
    """DuckDB text: the stand-ins the query mentions, then the query (which may start with its own WITH list
    written as ``, name AS (...)``)."""
    names = {n: n for n in DRIVER_TABLES}
    parts = [f"{n} AS ({sql.format(**names)})" for n, sql in STANDINS.items() if n in query]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {query.strip()}"
