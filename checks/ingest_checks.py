"""Dump ingest, exports, and aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks.standins import catalog, driver_table, with_standins
from prosopo.operators import aggregates as ag
from prosopo.plans import code_queries as cq
from prosopo.session import new_folder
from prosopo.sources import dictionary, dump, lists, tables

QUERIES = {}
ORACLES = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def literal(c: str, quoted: bool):
    """A dump literal: quoted and escaped text, or digits, or NULL."""
    if not quoted:
        return F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    v = F.col(c).cast("string")
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\x00", "\\0"), ("\x1a", "\\Z")):
        v = F.replace(v, F.lit(plain), F.lit(escaped))
    return F.coalesce(F.concat(F.lit("'"), v, F.lit("'")), F.lit("NULL"))


def as_dump(df: DataFrame, table: str, columns: dict[str, str], key: str, per_statement: int = 20) -> DataFrame:
    """Statements (CREATE, then INSERTs of a few rows each) for a table with a unique integer key."""
    values = F.concat(F.lit("("), F.concat_ws(",", *[literal(c, not t.startswith(("int", "bigint", "double"))) for c, t in columns.items()]), F.lit(")"))
    inserts = (df.select(F.floor(F.col(key) / per_statement).alias("g"), values.alias("v")).groupBy("g")
               .agg(F.concat(F.lit(f"-- Dumping data for table\nINSERT INTO `{table}` VALUES "), F.array_join(F.collect_list("v"), ",")).alias("value")))
    lines = ",\n".join(f"  `{c}` {t} DEFAULT NULL" for c, t in columns.items())
    create = f"/*!40101 SET NAMES utf8mb4 */;\nDROP TABLE IF EXISTS `{table}`;\nCREATE TABLE `{table}` (\n{lines},\n  KEY `k` (`{key}`)\n) ENGINE=InnoDB"
    return df.sparkSession.range(1).select(F.lit(create).alias("value")).union(inserts.select("value"))


ORDER_COLUMNS = {"o_orderkey": "bigint(20)", "o_custkey": "int(11)", "o_orderstatus": "char(1)", "o_totalprice": "double", "o_orderdate": "datetime",
                 "o_orderpriority": "varchar(20)"}
DOC_COLUMNS = {"doc_id": "int(11)", "text": "longtext", "lang": "varchar(8)", "source": "varchar(20)", "n_chars": "int(11)"}
CUSTOMER_COLUMNS = {"c_custkey": "int(11)", "c_name": "varchar(40)", "c_nationkey": "int(11)", "c_acctbal": "double", "c_mktsegment": "varchar(20)"}


def ingest(s, d) -> dump.Dump:
    """The driver's orders and documents as dump files, read back."""
    folder = new_folder(s, "dump-text")
    orders = driver_table(s, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    statements = as_dump(orders, "orders_copy", ORDER_COLUMNS, "o_orderkey").union(
        as_dump(driver_table(s, d, "documents"), "documents_copy", DOC_COLUMNS, "doc_id")).union(
        as_dump(driver_table(s, d, "nation"), "internal__nation", {"n_nationkey": "int(11)", "n_name": "varchar(25)"}, "n_nationkey"))
    statements.write.option("lineSep", ";\n").text(folder)
    return dump.read_dump(s, folder, internal_prefix="internal__")


add("dump_ingest_orders", lambda s, d: ingest(s, d).tables["orders_copy"],
    """SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders""")
add("dump_ingest_texts", lambda s, d: ingest(s, d).tables["documents_copy"],
    "SELECT CAST(doc_id AS INT) AS doc_id, text, lang, source, CAST(n_chars AS INT) AS n_chars FROM documents")


def newest(s, d):
    """Three dated dumps in parts, the newest that can be read compressed: it is chosen by its name and read."""
    folder = new_folder(s, "dumps")
    orders = driver_table(s, d, "orders")
    for name, how, rows in (("orders_20240229.sql", {}, orders.where("o_orderstatus = 'F'")), ("orders_20251105.sql.gz", {"compression": "gzip"}, orders),
                            ("orders_20260101.7z", {}, orders.where("o_orderstatus = 'O'"))):
        as_dump(rows, "orders_copy", ORDER_COLUMNS, "o_orderkey").write.options(lineSep=";\n", **how).text(f"{folder}/{name}")
    found = dump.latest_dump(dump.list_files(s, folder, parts=True), "orders_", dump.READABLE).first()
    return dump.read_dump(s, found["path"]).tables["orders_copy"].withColumn("date_tag", F.lit(found["date_tag"]))


add("dump_newest", newest, """SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
    '20251105' AS date_tag FROM orders""")


def build(s, d):
    """Ingest, write the tables, and report what was built."""
    got = ingest(s, d)
    return tables.write_tables(got.tables, new_folder(s, "tables"), got.skipped).withColumn("tables_skipped", F.array_join("tables_skipped", ","))


add("build_stats", build, """SELECT CAST(2 AS BIGINT) AS tables_created, (SELECT count(*) FROM orders) + (SELECT count(*) FROM documents) AS rows_inserted,
                             'internal__nation' AS tables_skipped""")


def overlay(s, d):
    """Column types of the dump with a dictionary laid over them; the sheet is made from the data's own columns."""
    folder = new_folder(s, "dump-text")
    as_dump(driver_table(s, d, "customer"), "customer_copy", CUSTOMER_COLUMNS, "c_custkey").write.option("lineSep", ";\n").text(folder)
    sheet = s.createDataFrame([
        ("1", "", "", "customer_copy", "c_custkey", "Primary Key", "Double", "no", "", ""),
        ("2", "", "", "customer_copy", "c_name", "", " ", "", "", ""),
        (None, None, None, " ", None, None, None, None, None, None)], ", ".join(f"{c} string" for c in dictionary.HEADER))
    checked = dictionary.load_dictionary(sheet)
    return dump.read_dump(s, folder, overlay=checked).tables["customer_copy"]


add("dump_with_dictionary", overlay, "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")


def packed(s, d, **how):
    """The customers as a dump with other line ends or packed, read back whole."""
    folder = new_folder(s, "dump-text")
    end = how.pop("lineSep", ";\n")
    as_dump(driver_table(s, d, "customer"), "customer_copy", CUSTOMER_COLUMNS, "c_custkey").write.options(lineSep=end, **how).text(folder)
    return dump.read_dump(s, folder).tables["customer_copy"]


_CUSTOMERS = "SELECT CAST(c_custkey AS INT) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
add("dump_gzip", lambda s, d: packed(s, d, compression="gzip"), _CUSTOMERS)
add("dump_crlf", lambda s, d: packed(s, d, lineSep=";\r\n"), _CUSTOMERS)


def kept_rejects(s, d):
    """Orders with a value missing here and there, and rows of a table that is never declared."""
    folder = new_folder(s, "dump-text")
    orders = driver_table(s, d, "orders")
    short = orders.where("o_orderkey % 11 = 0").select(F.concat(F.lit("INSERT INTO `orders_copy` VALUES ("), "o_orderkey", F.lit(",'"), F.repeat("o_orderpriority", 40), F.lit("')")).alias("value"))
    lost = orders.where("o_orderkey % 13 = 0").select(F.concat(F.lit("INSERT INTO `lost` VALUES ("), "o_orderkey", F.lit(")")).alias("value"))
    broken = orders.where("o_orderkey % 17 = 0").select(F.concat(F.lit("INSERT INTO `orders_copy` VALUES ("), "o_orderkey", F.lit(",WHAT)")).alias("value"))
    (as_dump(orders, "orders_copy", ORDER_COLUMNS, "o_orderkey").union(short).union(lost).union(broken)).write.option("lineSep", ";\n").text(folder)
    got = dump.read_dump(s, folder, on_reject="keep")
    rejected = got.rejected.groupBy("table", "reason").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("sample")).alias("characters"))
    return rejected.union(got.tables["orders_copy"].groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit("orders_copy"), F.lit("read"), "rows", F.lit(None)))


add("dump_kept_rejects", kept_rejects, """
    SELECT 'orders_copy' AS "table", 'number of values differs from the columns' AS reason, count(*) AS rows,
      CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 3 + 40 * length(o_orderpriority)) AS BIGINT) AS characters FROM orders WHERE o_orderkey % 11 = 0
    UNION ALL SELECT 'lost', 'row of an undeclared table', count(*), sum(length(CAST(o_orderkey AS VARCHAR))) FROM orders WHERE o_orderkey % 13 = 0
    UNION ALL SELECT 'orders_copy', 'not a list of VALUES tuples', count(*), sum(length(CAST(o_orderkey AS VARCHAR)) + length('INSERT INTO `orders_copy` VALUES (,WHAT)')) FROM orders WHERE o_orderkey % 17 = 0
    UNION ALL SELECT 'orders_copy', 'read', count(*), NULL FROM orders""")


def zero_values(s, d):
    """Zero dates, and bits written as characters, in every few orders."""
    folder = new_folder(s, "dump-text")
    row = driver_table(s, d, "orders").select(F.concat_ws(
        "", F.lit("INSERT INTO `v` VALUES ("), "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(",'\\0'")).when(F.col("o_orderkey") % 3 == 1, F.lit(",'\x01'")).otherwise(F.lit(",NULL")),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(",'0000-00-00'")).otherwise(F.concat(F.lit(",'"), F.col("o_orderdate").cast("date").cast("string"), F.lit("'"))),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(",'0000-00-00 00:00:00'")).otherwise(F.concat(F.lit(",'"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("'"))), F.lit(")")).alias("value"))
    head = s.range(1).select(F.lit("CREATE TABLE `v` (`id` bigint(20), `flag` bit(1), `day` date, `at` datetime)").alias("value"))
    head.union(row).write.option("lineSep", ";\n").text(folder)
    return dump.read_dump(s, folder).tables["v"]


add("dump_zero_values", zero_values, """
    SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS flag,
      CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 5 <> 0 THEN date_trunc('second', o_orderdate) END AS at FROM orders""")
add("constraint_report", lambda s, d: dictionary.constraint_report(catalog(s, d)["ENTRY_DATA"], ["c_personid", "c_entry_code"], ["c_year", "c_sequence", "c_personid"]),
    with_standins("""SELECT 'key' AS "constraint", 'c_personid,c_entry_code' AS columns,
          (SELECT count(*) FROM (SELECT 1 FROM ENTRY_DATA GROUP BY c_personid, c_entry_code HAVING count(*) > 1)) AS violations
        UNION ALL SELECT 'not null', 'c_year', (SELECT count(*) FROM ENTRY_DATA WHERE c_year IS NULL)
        UNION ALL SELECT 'not null', 'c_sequence', (SELECT count(*) FROM ENTRY_DATA WHERE c_sequence IS NULL)
        UNION ALL SELECT 'not null', 'c_personid', (SELECT count(*) FROM ENTRY_DATA WHERE c_personid IS NULL)"""))


def list_round_trip(s, d):
    """Codes saved as a list, read back, and used as the code set of a query."""
    c = catalog(s, d)
    path = new_folder(s, "codes")
    lists.write_codes(lists.selected_codes(c["OFFICE_CODES"], c["ALTNAME_DATA"].select("c_source"), "c_office_id", "c_office_trans", "c_office_chn"), path)
    codes = lists.read_codes(s, path)
    return cq.office_query(c, cq.office_request(office_codes=codes, limit=None)).groupBy("office_code").agg(F.count(F.lit(1)).alias("rows"))


add("code_list_round_trip", list_round_trip, with_standins("""
    SELECT CAST(f.c_office_id AS VARCHAR) AS office_code, count(*) AS rows
    FROM POSTED_TO_OFFICE_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid
    LEFT JOIN POSTED_TO_ADDR_DATA a ON a.c_posting_id = f.c_posting_id AND a.c_office_id = f.c_office_id AND a.c_personid = f.c_personid
    WHERE f.c_office_id IN (SELECT c_office_id FROM OFFICE_CODES WHERE c_office_id IN (SELECT c_source FROM ALTNAME_DATA)) GROUP BY 1"""))


def graph_export(s, d, which):
    rows = cq.entry_query(catalog(s, d), cq.entry_request(limit=None))
    folder = new_folder(s, "graph")
    lists.write_graph(lists.graph_tables(
        rows, ["person_id", "name"], ["entry_code", "entry_method"], ["entry_address_id", "entry_address"],
        ["person_id", "entry_code", "sequence"]), folder)
    return s.read.csv(f"{folder}/{which}", header=True, nullValue="\x00", emptyValue="")


add("graph_export_codes", lambda s, d: graph_export(s, d, "codes"), with_standins(
    """SELECT DISTINCT CAST(f.c_entry_code AS VARCHAR) AS entry_code, coalesce(c.c_entry_desc_chn, c.c_entry_desc) AS entry_method
       FROM ENTRY_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid LEFT JOIN ENTRY_CODES c ON c.c_entry_code = f.c_entry_code WHERE f.c_entry_code IS NOT NULL"""))
add("graph_export_places", lambda s, d: graph_export(s, d, "places"), with_standins(
    """SELECT DISTINCT CAST(f.c_entry_addr_id AS VARCHAR) AS entry_address_id, coalesce(a.c_name_chn, a.c_name) AS entry_address
       FROM ENTRY_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid LEFT JOIN ADDR_CODES a ON a.c_addr_id = f.c_entry_addr_id WHERE f.c_entry_addr_id IS NOT NULL"""))
add("graph_export_people", lambda s, d: graph_export(s, d, "people"), with_standins(
    "SELECT DISTINCT CAST(b.c_personid AS VARCHAR) AS person_id, b.c_name AS name FROM ENTRY_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid"))
add("graph_export_edges", lambda s, d: graph_export(s, d, "edges"), with_standins(
    """SELECT CAST(b.c_personid AS VARCHAR) AS person_id, CAST(f.c_entry_code AS VARCHAR) AS entry_code, CAST(coalesce(f.c_sequence, 0) AS VARCHAR) AS "sequence"
       FROM ENTRY_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid"""))


def map_export(s, d):
    path = new_folder(s, "map")
    rows = catalog(s, d)["ENTRY_DATA"].select("c_personid", "c_entry_code", "c_entry_addr_id")
    lists.write_map(lists.map_table(rows, catalog(s, d)["ADDR_CODES"], "c_entry_addr_id"), path)
    return s.read.schema("c_personid bigint, c_entry_code int, c_entry_addr_id bigint, x double, y double").csv(path, sep="\t", header=True)


add("map_export", map_export, with_standins("""SELECT f.c_personid, f.c_entry_code, f.c_entry_addr_id, a.x_coord AS x, a.y_coord AS y
    FROM ENTRY_DATA f LEFT JOIN ADDR_CODES a ON a.c_addr_id = f.c_entry_addr_id"""))

add("top_codes", lambda s, d: ag.top_codes(catalog(s, d)["POSTED_TO_OFFICE_DATA"], "c_office_id", "c_personid", 50),
    with_standins("SELECT c_office_id, count(DISTINCT c_personid) AS people FROM POSTED_TO_OFFICE_DATA GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"))
add("top_codes_pruned", lambda s, d: ag.top_codes_pruned(catalog(s, d)["POSTED_TO_OFFICE_DATA"], "c_office_id", "c_personid", 50),
    with_standins("SELECT c_office_id, count(DISTINCT c_personid) AS people FROM POSTED_TO_OFFICE_DATA GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"))
add("code_by_dynasty", lambda s, d: ag.code_by_dynasty(catalog(s, d)["ENTRY_DATA"], catalog(s, d)["BIOG_MAIN"], "c_entry_code", 20),
    with_standins("""SELECT f.c_entry_code, b.c_dy, count(DISTINCT f.c_personid) AS people FROM ENTRY_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid
                     GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20"""))
add("value_histogram", lambda s, d: ag.histogram(catalog(s, d)["BIOG_MAIN"], "c_female"),
    with_standins("SELECT c_female, count(*) AS rows FROM BIOG_MAIN GROUP BY 1"))
add("birth_year_histogram", lambda s, d: ag.year_histogram(catalog(s, d)["BIOG_MAIN"], "c_birthyear", 25),
    with_standins("SELECT CAST(floor(c_birthyear / 25) * 25 AS INT) AS bin_start, count(*) AS rows FROM BIOG_MAIN GROUP BY 1"))
add("frequency_tables", lambda s, d: ag.frequency(catalog(s, d)["BIOG_MAIN"], ["c_dy", "c_female"]),
    with_standins("SELECT c_dy, c_female, CAST(grouping_id(c_dy, c_female) AS INT) AS level, count(*) AS rows FROM BIOG_MAIN GROUP BY CUBE (c_dy, c_female)"))
add("cross_tab", lambda s, d: ag.cross_tab(
        catalog(s, d)["STATUS_DATA"].join(catalog(s, d)["BIOG_MAIN"].select("c_personid", "c_dy"), "c_personid"), "c_dy", "c_status_code", [1, 2, 3]),
    with_standins("""SELECT b.c_dy, count(*) FILTER (WHERE c_status_code = 1) AS c_status_code_1, count(*) FILTER (WHERE c_status_code = 2) AS c_status_code_2,
        count(*) FILTER (WHERE c_status_code = 3) AS c_status_code_3, count(*) FILTER (WHERE c_status_code NOT IN (1, 2, 3)) AS other
        FROM STATUS_DATA f JOIN BIOG_MAIN b ON b.c_personid = f.c_personid GROUP BY 1"""))
add("dynasty_bracket", lambda s, d: ag.dynasty_bracket(catalog(s, d)["DYNASTIES"], catalog(s, d)["BIOG_MAIN"].where("c_index_year > 1000").select("c_dy")),
    with_standins("""SELECT min(c_dy) AS from_dynasty, max(c_dy) AS to_dynasty, coalesce(min(c_start), 0) AS dynasty_begin, coalesce(max(c_end), 0) AS dynasty_end
                     FROM DYNASTIES WHERE c_dy IN (SELECT c_dy FROM BIOG_MAIN WHERE c_index_year > 1000)"""))
