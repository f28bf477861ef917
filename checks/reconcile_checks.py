"""Comparisons and reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.standins import catalog, driver_table, with_standins
from prosopo.operators import checksums as cs, reconcile as rc
from prosopo.plans import people, report, report_store
from prosopo.session import new_folder
from prosopo.sources import tables

QUERIES = {}
ORACLES = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# two copies of the orders: the right one lacks a priority, has rows of its own, edits and other number types
LEFT = """SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 10 END AS BIGINT) AS part,
                 o_orderstatus AS status, o_custkey AS n, CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS DOUBLE) AS price,
                 substr(o_orderpriority, 1, 1) AS grade
          FROM {orders}"""
RIGHT = """SELECT CAST(o_orderkey AS INT) AS id, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 10 END AS INT) AS part,
                  CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CAST(o_custkey + CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS n,
                  CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS DOUBLE) AS price,
                  CAST(substr(o_orderpriority, 1, 1) AS INT) AS grade
           FROM {orders} WHERE o_orderpriority <> '5-LOW'
           UNION ALL
           SELECT CAST(-1 - o_orderkey AS INT), CAST(NULL AS INT), o_orderstatus, CAST(o_custkey AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS INT)
           FROM {orders} WHERE o_orderstatus = 'P'"""
# lineitem repeats (l_orderkey, l_linenumber): the natural case of a key that is not unique
LINES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM {lineitem}"""
LINES_B = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 4 = 0 THEN 'Q' ELSE l_returnflag END AS l_returnflag
             FROM {lineitem} WHERE l_linestatus = 'O' OR l_returnflag <> 'N'"""


def frame(s, d, sql):
    used = {t: driver_table(s, d, t) for t in ("orders", "lineitem") if "{" + t + "}" in sql}
    return s.sql(sql, **used)


def sides(s, d):
    return frame(s, d, LEFT), frame(s, d, RIGHT)


def shown(result, *keys):
    """The differing fields as one text, so that rows compare easily."""
    return result.select(*keys, "bucket", F.array_join(F.transform(
        "differing", lambda x: F.concat(x["field"], F.lit(":"), F.coalesce(x["left"], F.lit("~")), F.lit(">"), F.coalesce(x["right"], F.lit("~")))),
        ";").alias("differing"))


_T = {"orders": "orders", "lineitem": "lineitem"}
BOTH = f"""WITH l AS ({LEFT.format(**_T)}), r AS ({RIGHT.format(**_T)}),
  j AS (SELECT coalesce(l.id, r.id) AS id, coalesce(l.part, r.part) AS part, l.id IS NOT NULL AS in_l, r.id IS NOT NULL AS in_r,
          l.status AS ls, r.status AS rs, l.n AS ln, r.n AS rn, l.price AS lp, r.price AS rp, l.grade AS lg, r.grade AS rg
        FROM l FULL OUTER JOIN r ON l.id IS NOT DISTINCT FROM r.id AND l.part IS NOT DISTINCT FROM r.part),
  c AS (SELECT *, concat_ws(';',
          CASE WHEN ls IS DISTINCT FROM rs THEN 'status:' || coalesce(ls, '~') || '>' || coalesce(rs, '~') END,
          CASE WHEN ln IS DISTINCT FROM rn THEN 'n:' || coalesce(CAST(ln AS VARCHAR), '~') || '>' || coalesce(CAST(rn AS VARCHAR), '~') END,
          CASE WHEN lp IS DISTINCT FROM rp THEN 'price:' || coalesce(CAST(lp AS VARCHAR), '~') || '>' || coalesce(CAST(rp AS VARCHAR), '~') END) AS diffs
        FROM j),
  v AS (SELECT id, part, CASE WHEN NOT in_r THEN 'only_left' WHEN NOT in_l THEN 'only_right' WHEN diffs <> '' THEN 'mismatch' ELSE 'match' END AS bucket,
          CASE WHEN in_l AND in_r THEN diffs ELSE '' END AS differing, ls, rs FROM c)"""
COMPARED = ["status", "n", "price"]
STATS = """CAST(count(*) FILTER (WHERE bucket <> 'only_right') AS BIGINT) AS rows_left, count(*) FILTER (WHERE bucket <> 'only_left') AS rows_right,
           count(*) FILTER (WHERE bucket = 'match') AS rows_matching, count(*) FILTER (WHERE bucket = 'only_left') AS rows_only_left,
           count(*) FILTER (WHERE bucket = 'only_right') AS rows_only_right, count(*) FILTER (WHERE bucket = 'mismatch') AS rows_mismatch,
           count(*) FILTER (WHERE bucket <> 'match') = 0 AS matches"""


def main_diff(s, d, **more):
    left, right = sides(s, d)
    return rc.diff(left, right, ["id", "part"], COMPARED, **more)


add("diff_by_key", lambda s, d: shown(main_diff(s, d), "id", "part"), f"{BOTH} SELECT id, part, bucket, differing FROM v")
add("diff_stats", lambda s, d: rc.diff_stats(main_diff(s, d)), f"{BOTH} SELECT {STATS} FROM v")
add("diff_columns_subset", lambda s, d: rc.diff_stats(rc.diff(*sides(s, d), ["id", "part"], ["status"])),
    f"""{BOTH}, w AS (SELECT CASE WHEN bucket IN ('match', 'mismatch') THEN CASE WHEN ls IS DISTINCT FROM rs THEN 'mismatch' ELSE 'match' END
          ELSE bucket END AS bucket FROM v) SELECT {STATS} FROM w""")
add("diff_text_and_number", lambda s, d: rc.diff(*sides(s, d), ["id", "part"], ["grade"]).groupBy("bucket").agg(F.count(F.lit(1)).alias("keys")),
    f"{BOTH} SELECT CASE WHEN bucket = 'match' THEN 'mismatch' ELSE bucket END AS bucket, count(*) AS keys FROM v GROUP BY 1")
add("diff_with_rows", lambda s, d: main_diff(s, d, with_rows=True).select(
        "id", "part", "bucket", F.col("left_row.status").alias("left_status"), F.col("right_row.status").alias("right_status")),
    f"{BOTH} SELECT id, part, bucket, ls AS left_status, rs AS right_status FROM v")


def by_checksums(s, d):
    """(rows, stats) from two stored tables whose checksums are compared first."""
    return cs.checksum_diff(*(cs.checksummed(x, ["id", "part"], COMPARED, bits=6) for x in sides(s, d)))


# ten of the keys, or so, are edited: the others are known by their checksums alone
EDITED = "SELECT id, part, CASE WHEN id % 1537 = 5 THEN 'Y' ELSE status END AS status, n, price FROM ({left})"


def few_edits(s, d):
    left = sides(s, d)[0].drop("grade")
    right = s.sql(EDITED.replace("({left})", "{left}"), left=left)
    return cs.checksum_diff(*(cs.checksummed(x, ["id", "part"], COMPARED, bits=6) for x in (left, right)))


add("diff_by_checksums", lambda s, d: shown(by_checksums(s, d)[0], "id", "part"), f"{BOTH} SELECT id, part, bucket, differing FROM v WHERE bucket <> 'match'")
add("diff_by_checksums_stats", lambda s, d: by_checksums(s, d)[1], f"{BOTH} SELECT {STATS} FROM v")
add("diff_by_checksums_few", lambda s, d: shown(few_edits(s, d)[0], "id", "part"), f"""WITH l AS ({LEFT.format(**_T)})
    SELECT id, part, 'mismatch' AS bucket, 'status:' || status || '>Y' AS differing FROM l WHERE id % 1537 = 5""")


def last_rows(s, d):
    return shown(rc.diff(frame(s, d, LINES), frame(s, d, LINES_B), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_returnflag"],
                         on_duplicate="last", order_by=["l_partkey", "l_suppkey"]), "l_orderkey", "l_linenumber")


LAST = """QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) = 1"""
add("diff_keep_last", last_rows, f"""WITH l AS (SELECT * FROM ({LINES.format(**_T)}) {LAST}), r AS (SELECT * FROM ({LINES_B.format(**_T)}) {LAST})
    SELECT coalesce(l.l_orderkey, r.l_orderkey) AS l_orderkey, coalesce(l.l_linenumber, r.l_linenumber) AS l_linenumber,
      CASE WHEN r.l_orderkey IS NULL THEN 'only_left' WHEN l.l_orderkey IS NULL THEN 'only_right'
           WHEN l.l_partkey <> r.l_partkey OR l.l_returnflag <> r.l_returnflag THEN 'mismatch' ELSE 'match' END AS bucket,
      CASE WHEN l.l_orderkey IS NULL OR r.l_orderkey IS NULL THEN '' ELSE concat_ws(';',
        CASE WHEN l.l_partkey <> r.l_partkey THEN 'l_partkey:' || l.l_partkey || '>' || r.l_partkey END,
        CASE WHEN l.l_returnflag <> r.l_returnflag THEN 'l_returnflag:' || l.l_returnflag || '>' || r.l_returnflag END) END AS differing
    FROM l FULL OUTER JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber""")
add("duplicate_keys", lambda s, d: rc.duplicate_keys(frame(s, d, LINES), ["l_orderkey", "l_linenumber"]),
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")


# keys beyond what a double holds: of two neighbours only one has an equal on the right
BIG = "SELECT o_orderkey + 9007199254740992 AS id, o_orderstatus AS status FROM {orders}"
BIG_REAL = "SELECT CAST(o_orderkey + 9007199254740992 AS DOUBLE) AS id, max(o_orderstatus) AS status FROM {orders} GROUP BY 1"
add("diff_exact_keys", lambda s, d: rc.diff(frame(s, d, BIG), frame(s, d, BIG_REAL), ["id"]).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("keys"), F.min("id").alias("first")),
    f"""WITH l AS (SELECT CAST(id AS HUGEINT) AS id, status FROM ({BIG.format(**_T)})), r AS (SELECT CAST(id AS HUGEINT) AS id, status FROM ({BIG_REAL.format(**_T)})),
        j AS (SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'only_left' WHEN l.id IS NULL THEN 'only_right'
                WHEN l.status IS DISTINCT FROM r.status THEN 'mismatch' ELSE 'match' END AS bucket FROM l FULL OUTER JOIN r ON l.id = r.id)
        SELECT bucket, count(*) AS keys, min(CAST(id AS VARCHAR)) AS first FROM j GROUP BY 1""")
TRUTH = "SELECT o_orderstatus = 'O' AS id, count(*) AS n FROM {orders} GROUP BY 1"
WHOLE = "SELECT CAST(o_orderkey % 3 AS INT) AS id, count(*) AS n FROM {orders} GROUP BY 1"
add("diff_truth_keys", lambda s, d: shown(rc.diff(frame(s, d, TRUTH), frame(s, d, WHOLE), ["id"]), "id"),
    f"""SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'only_left' WHEN l.id IS NULL THEN 'only_right' WHEN l.n <> r.n THEN 'mismatch' ELSE 'match' END AS bucket,
          CASE WHEN l.n <> r.n THEN 'n:' || l.n || '>' || r.n ELSE '' END AS differing
        FROM (SELECT CAST(id AS INT) AS id, n FROM ({TRUTH.format(**_T)})) l FULL OUTER JOIN ({WHOLE.format(**_T)}) r ON l.id = r.id""")


def ordered_with_ties(s, d):
    """One row of each status is edited; the order says nothing within a status, and the key is of another type."""
    left = driver_table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    last = left.groupBy("o_orderstatus").agg(F.max("o_orderkey").alias("last"))
    right = (left.join(last, "o_orderstatus").withColumn("o_orderkey", F.when(F.col("o_orderkey") == F.col("last"), -1).otherwise(F.col("o_orderkey")).cast("double"))
             .select("o_orderkey", "o_orderstatus"))
    return rc.diff_stats(rc.ordered_diff(left, right, ["o_orderstatus"]))


add("ordered_diff_ties", ordered_with_ties, """
    WITH e AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS edits FROM orders)
    SELECT n AS rows_left, n AS rows_right, n - edits AS rows_matching, CAST(0 AS BIGINT) AS rows_only_left, CAST(0 AS BIGINT) AS rows_only_right,
      edits AS rows_mismatch, edits = 0 AS matches FROM e""")


def ordered(s, d):
    left, right = sides(s, d)
    return shown(rc.ordered_diff(left.select("id", "status"), right.select("id", "status"), ["id"]), "position")


add("ordered_diff", ordered, f"""WITH l AS (SELECT id, status, row_number() OVER (ORDER BY id) AS position FROM ({LEFT.format(**_T)})),
    r AS (SELECT id, status, row_number() OVER (ORDER BY id) AS position FROM ({RIGHT.format(**_T)}))
    SELECT coalesce(l.position, r.position) AS position,
      CASE WHEN r.id IS NULL THEN 'only_left' WHEN l.id IS NULL THEN 'only_right'
           WHEN l.id <> r.id OR l.status <> r.status THEN 'mismatch' ELSE 'match' END AS bucket,
      CASE WHEN l.id IS NULL OR r.id IS NULL THEN '' ELSE concat_ws(';', CASE WHEN l.id <> r.id THEN 'id:' || l.id || '>' || r.id END,
        CASE WHEN l.status <> r.status THEN 'status:' || l.status || '>' || r.status END) END AS differing
    FROM l FULL OUTER JOIN r ON l.position = r.position""")


def ordered_per_person(s, d):
    c = catalog(s, d)
    a = c["ENTRY_DATA"].select("c_personid", "c_year", "c_sequence", "c_exam_rank").where("c_sequence is not null")
    b = a.withColumn("c_exam_rank", F.when(F.col("c_year") > 1100, "Z").otherwise(F.col("c_exam_rank")))
    return rc.diff_stats(rc.ordered_diff(a, b, ["c_sequence"], keys=["c_personid"], ignore=["c_year"]))


add("ordered_diff_per_person", ordered_per_person, with_standins("""
    SELECT count(*) AS rows_left, count(*) AS rows_right, count(*) FILTER (WHERE coalesce(c_year, 0) <= 1100) AS rows_matching,
      CAST(0 AS BIGINT) AS rows_only_left, CAST(0 AS BIGINT) AS rows_only_right, count(*) FILTER (WHERE c_year > 1100) AS rows_mismatch,
      count(*) FILTER (WHERE c_year > 1100) = 0 AS matches FROM ENTRY_DATA WHERE c_sequence IS NOT NULL"""))

COUNTED = ("ENTRY_DATA", "STATUS_DATA", "KIN_DATA", "BIOG_MAIN")


def two_catalogs(s, d):
    c = catalog(s, d)
    a = {t: c[t] for t in COUNTED}
    b = {"ENTRY_DATA": c["ENTRY_DATA"], "status_data": c["STATUS_DATA"], "KIN_DATA": c["KIN_DATA"].where("c_kin_id is not null"), "BIOG_MAIN": c["BIOG_MAIN"]}
    return rc.count_diff(a, b)


add("table_counts", lambda s, d: rc.table_counts(catalog(s, d)), with_standins(" UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in __import__("checks.standins", fromlist=["STANDINS"]).STANDINS)))
add("count_diff", two_catalogs, with_standins("""
    SELECT 'ENTRY_DATA' AS "table", (SELECT count(*) FROM ENTRY_DATA) AS left_rows, (SELECT count(*) FROM ENTRY_DATA) AS right_rows, 'match' AS bucket
    UNION ALL SELECT 'BIOG_MAIN', (SELECT count(*) FROM BIOG_MAIN), (SELECT count(*) FROM BIOG_MAIN), 'match'
    UNION ALL SELECT 'STATUS_DATA', (SELECT count(*) FROM STATUS_DATA), NULL, 'only_left'
    UNION ALL SELECT 'status_data', NULL, (SELECT count(*) FROM STATUS_DATA), 'only_right'
    UNION ALL SELECT 'KIN_DATA', (SELECT count(*) FROM KIN_DATA), (SELECT count(c_kin_id) FROM KIN_DATA), 'mismatch'"""))
add("key_sets", lambda s, d: rc.key_sets(*sides(s, d), ["id", "part"]), f"""WITH l AS ({LEFT.format(**_T)}), r AS ({RIGHT.format(**_T)})
    SELECT id, part, CASE max(w) + min(w) WHEN 2 THEN 'only_left' WHEN 4 THEN 'only_right' ELSE 'both' END AS side
    FROM (SELECT id, part, 1 AS w FROM l UNION ALL SELECT id, part, 2 FROM r) GROUP BY 1, 2""")
add("missing_keys", lambda s, d: rc.missing_keys(*sides(s, d), ["id", "status"]), f"""WITH l AS ({LEFT.format(**_T)}), r AS ({RIGHT.format(**_T)})
    SELECT id, status FROM l EXCEPT SELECT id, status FROM r""")


def divergence(s, d):
    known = driver_table(s, d, "orders").where("o_orderpriority = '5-LOW' and o_orderstatus <> 'O'").selectExpr(
        "o_orderkey as id", "cast(case when o_orderkey % 5 = 0 then null else o_custkey % 10 end as bigint) as part")
    return rc.documented_divergence(main_diff(s, d), known, ["id", "part"])


add("documented_divergence", divergence, f"""{BOTH}
    SELECT id, part, 'undocumented' AS problem FROM v WHERE bucket = 'only_left' AND ls = 'O'
    UNION ALL SELECT id, part, bucket FROM v WHERE bucket IN ('only_right', 'mismatch')""")


def variants(s, d):
    e = catalog(s, d)["ENTRY_DATA"]
    return rc.containment({
        "all": e, "coded": e.where("c_entry_code in (1, 2)"), "dated": e.where("c_year between 950 and 1150"),
        "none": e.where("c_entry_code = 99")}, ["c_personid", "c_entry_code"])


add("containment", variants, with_standins("""
    , v AS (SELECT DISTINCT 'all' AS v, c_personid, c_entry_code FROM ENTRY_DATA
            UNION SELECT 'coded', c_personid, c_entry_code FROM ENTRY_DATA WHERE c_entry_code IN (1, 2)
            UNION SELECT 'dated', c_personid, c_entry_code FROM ENTRY_DATA WHERE c_year BETWEEN 950 AND 1150),
    n AS (SELECT unnest(['all', 'coded', 'dated', 'none']) AS v)
    SELECT a.v AS variant, b.v AS in_variant, (SELECT count(*) FROM v WHERE v.v = a.v) AS size,
      (SELECT count(*) FROM v x JOIN v y ON x.c_personid = y.c_personid AND x.c_entry_code = y.c_entry_code WHERE x.v = a.v AND y.v = b.v) AS overlap,
      CASE WHEN (SELECT count(*) FROM v WHERE v.v = a.v) > 0 THEN
        (SELECT count(*) FROM v x JOIN v y ON x.c_personid = y.c_personid AND x.c_entry_code = y.c_entry_code WHERE x.v = a.v AND y.v = b.v)
        / (SELECT count(*) FROM v WHERE v.v = a.v) END AS share
    FROM n a, n b"""))


def case_frames(s, d):
    """One case per order priority; in the right copy one priority is missing altogether."""
    left, right = sides(s, d)
    left = left.withColumn("case_id", F.concat(F.lit("grade "), "grade"))
    right = right.withColumn("case_id", F.concat(F.lit("grade "), F.coalesce(F.col("grade").cast("string"), F.lit("?"))))
    cases = driver_table(s, d, "orders").select(F.concat(F.lit("grade "), F.substring("o_orderpriority", 1, 1)).alias("case_id")).distinct().union(
        driver_table(s, d, "region").select(F.concat(F.lit("region "), "r_name").alias("case_id"))).select(
        "case_id", F.substring_index("case_id", " ", 1).alias("category"),
        F.when(F.col("case_id") == "grade 1", "skip").when(F.col("case_id") == "grade 2", "xfail")
        .when(F.col("case_id") == "region ASIA", "empty").otherwise("pass").alias("expected"))
    return left, right, cases


def verdicts(s, d):
    left, right, cases = case_frames(s, d)
    return rc.case_verdicts(left, right, cases, ["id", "part"], ["status"])


CASES = f"""WITH l AS ({LEFT.format(**_T)}), r AS ({RIGHT.format(**_T)}),
    j AS (SELECT coalesce('grade ' || l.grade, 'grade ' || r.grade) AS case_id,
            CASE WHEN r.id IS NULL THEN 'only_left' WHEN l.id IS NULL THEN 'only_right' WHEN l.status <> r.status THEN 'mismatch' ELSE 'match' END AS bucket
          FROM l FULL OUTER JOIN r ON l.id = r.id AND l.part IS NOT DISTINCT FROM r.part),
    st AS (SELECT case_id, {STATS} FROM j GROUP BY 1),
    cases AS (SELECT DISTINCT 'grade ' || substr(o_orderpriority, 1, 1) AS case_id, 'grade' AS category FROM orders
              UNION ALL SELECT 'region ' || r_name, 'region' FROM region),
    out AS (SELECT c.*, CASE c.case_id WHEN 'grade 1' THEN 'skip' WHEN 'grade 2' THEN 'xfail' WHEN 'region ASIA' THEN 'empty' ELSE 'pass' END AS expected,
      coalesce(rows_left, 0) AS rows_left, coalesce(rows_right, 0) AS rows_right, coalesce(rows_matching, 0) AS rows_matching,
      coalesce(rows_only_left, 0) AS rows_only_left, coalesce(rows_only_right, 0) AS rows_only_right, coalesce(rows_mismatch, 0) AS rows_mismatch,
      coalesce(matches, true) AS matches FROM cases c LEFT JOIN st ON st.case_id = c.case_id),
    final AS (SELECT *, CASE WHEN expected = 'skip' THEN 'skip' WHEN rows_left + rows_right = 0 THEN CASE WHEN expected = 'empty' THEN 'pass' ELSE 'vacuous' END
      WHEN expected = 'xfail' THEN CASE WHEN matches THEN 'xpass' ELSE 'xfail' END WHEN matches THEN 'pass' ELSE 'fail' END AS verdict FROM out)"""
add("case_verdicts", verdicts, f"{CASES} SELECT * FROM final")
add("verdict_totals", lambda s, d: report.totals(verdicts(s, d), ["category"]),
    f"""{CASES} SELECT category, count(*) AS total, count(*) FILTER (WHERE matches) AS passing, count(*) FILTER (WHERE NOT matches) AS failing
        FROM final GROUP BY ROLLUP (category)""")


def empty_guard(s, d):
    v = verdicts(s, d)
    return rc.expected_empty_guard(v, v.where("expected = 'empty'").select("case_id")).select("case_id", "category")


add("expected_empty_guard", empty_guard, f"{CASES} SELECT case_id, category FROM final WHERE rows_left = 0 AND rows_right = 0 AND expected <> 'empty'")


def dashboards(s, d):
    """Three diffs stored as reports, then read back as the dashboard."""
    folder = new_folder(s, "reports")
    left, right = sides(s, d)
    report.write_report(rc.diff(left, right, ["id", "part"], COMPARED), folder, "copy", source_sha="0123456789abcdef")
    report.write_report(rc.diff(left, left, ["id", "part"], COMPARED), folder, "same")
    report.write_report(rc.diff(left, right, ["id", "part"], ["status"]), folder, "status")
    return report.dashboard(report.read_reports(s, f"{folder}/*/stats")).drop("generated")


add("report_dashboard", dashboards, f"""{BOTH},
    w AS (SELECT 'copy' AS q, bucket FROM v UNION ALL SELECT 'same', 'match' FROM l
          UNION ALL SELECT 'status', CASE WHEN bucket IN ('match', 'mismatch') THEN CASE WHEN ls IS DISTINCT FROM rs THEN 'mismatch' ELSE 'match' END ELSE bucket END FROM v),
    x AS (SELECT q, {STATS} FROM w GROUP BY q)
    SELECT q AS query_id, CASE WHEN matches THEN 'PASS' ELSE 'FAIL' END AS verdict, rows_left, rows_right, rows_matching, rows_only_left,
      rows_only_right, rows_mismatch, CASE q WHEN 'copy' THEN '0123456789ab' ELSE '(none)' END AS source FROM x""")



def stored_reports(s, d):
    """Three reports in one store: one stored once, one rewritten with other columns, and one whose rewrite ended half-way."""
    store = new_folder(s, "store")
    left, right = sides(s, d)
    report_store.store_report(rc.diff(left, right, ["id", "part"], ["n"]), store, "rewritten", source_sha="feedfacefeedface")
    report_store.store_report(rc.diff(left, right, ["id", "part"], COMPARED), store, "half-way", source_sha="0123456789abcdef")
    report_store.store_report(rc.diff(left, left, ["id", "part"], COMPARED), store, "same")
    report_store.store_report(rc.diff(left, right, ["id", "part"], ["status"]), store, "rewritten", source_sha="feedfacefeedface")
    report_store.store_rows(rc.diff(left, right, ["id", "part"], ["price"]), store, "half-way", "lost", 1)
    return store


add("report_store_dashboard", lambda s, d: report_store.store_dashboard(s, stored_reports(s, d)).drop("generated"), f"""{BOTH},
    w AS (SELECT bucket FROM v),
    u AS (SELECT CASE WHEN bucket IN ('match', 'mismatch') THEN CASE WHEN ls IS DISTINCT FROM rs THEN 'mismatch' ELSE 'match' END ELSE bucket END AS bucket FROM v),
    e AS (SELECT 'match' AS bucket FROM l),
    st AS (SELECT 'half-way' AS query_id, '0123456789ab' AS source, {STATS} FROM w UNION ALL SELECT 'rewritten', 'feedfacefeed', {STATS} FROM u
           UNION ALL SELECT 'same', '(none)', {STATS} FROM e)
    SELECT query_id, CASE WHEN matches THEN 'PASS' ELSE 'FAIL' END AS verdict, * EXCLUDE (query_id, matches) FROM st""")
add("report_store_rows", lambda s, d: report_store.report_rows(s, stored_reports(s, d)).select(
        "query_id", F.col("key")["id"].alias("id"), F.col("key")["part"].alias("part"), "bucket"), f"""{BOTH}
    SELECT 'half-way' AS query_id, CAST(id AS VARCHAR) AS id, CAST(part AS VARCHAR) AS part, bucket FROM v WHERE bucket <> 'match'
    UNION ALL SELECT 'rewritten', CAST(id AS VARCHAR), CAST(part AS VARCHAR), bucket FROM v WHERE bucket LIKE 'only%' OR bucket = 'mismatch' AND ls IS DISTINCT FROM rs""")


def stored_rows(s, d):
    """A report that keeps every row with both sides, in key order."""
    folder = new_folder(s, "reports")
    report.write_report(main_diff(s, d, with_rows=True), folder, "whole", keys=["id", "part"], every_row=True)
    return s.read.parquet(f"{folder}/whole/rows").select(
        "id", "part", "bucket", F.col("left_row.status").alias("left_status"), F.col("right_row.status").alias("right_status"))


add("report_rows", stored_rows, f"{BOTH} SELECT id, part, bucket, ls AS left_status, rs AS right_status FROM v")

# all columns; reals as whole hundredths and times as epoch seconds, so that both engines write them alike
PRINTED = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "CAST(round(c_acctbal * 100) AS BIGINT)", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "CAST(round(o_totalprice * 100) AS BIGINT)", "CAST({epoch}(o_orderdate) AS BIGINT)", "o_orderpriority"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
}


def prints(s, d):
    out = None
    for t, columns in PRINTED.items():
        frame_ = driver_table(s, d, t).selectExpr(*[f"{c.format(epoch='unix_seconds')} AS c{i}" if "epoch" not in c
                                                    else f"unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS c{i}" for i, c in enumerate(columns)])
        one = tables.fingerprint(frame_, "md5").withColumn("table", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out.select("table", "rows", F.col("hash_sum").cast("string").alias("hash_sum"), "hash_xor")


_text = lambda c: f"coalesce(length(CAST({c} AS VARCHAR)) || '=' || CAST({c} AS VARCHAR), '~')"
_prints = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS rows, CAST(sum(h) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT
        CAST(('0x' || substr(md5({' || '.join(_text(c.format(epoch='epoch')) for c in cols)}), 1, 15)) AS BIGINT) AS h FROM {t})""" for t, cols in PRINTED.items())
add("table_fingerprint", prints, _prints)


def file_hash_totals(s, d):
    """Documents staged as text files, one per line: what the hashes of the files say in sum."""
    folder = new_folder(s, "staged")
    driver_table(s, d, "documents").select(F.translate("text", "\r\n", "  ")).write.text(folder)
    return tables.file_hashes(s, folder).agg(F.sum("lines").alias("lines"), F.sum("length").alias("bytes"))


add("file_hash_totals", file_hash_totals, "SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents")


def ordered_files(s, d):
    """The orders as text files in key order, one for each ten thousand keys: hashes of numbered lines, which another engine can recompute."""
    folder = new_folder(s, "file-order")
    lines = driver_table(s, d, "orders").select(F.expr("o_orderkey div 10000").alias("part"), "o_orderkey",
                                                F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(folder)
    part = F.regexp_extract("path", r"part=(\d+)/", 1).cast("bigint").alias("part")
    return tables.file_hashes(s, f"{folder}/part=*", "md5").select(part, "lines", "length", F.col("hash_sum").cast("string").alias("hash_sum"))


add("file_hash_ordered", ordered_files, """WITH l AS (SELECT o_orderkey // 10000 AS part, concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority) AS t,
      row_number() OVER (PARTITION BY o_orderkey // 10000 ORDER BY o_orderkey) AS n FROM orders)
    SELECT part, count(*) AS lines, CAST(sum(strlen(t) + 1) AS BIGINT) AS length, CAST(sum(CAST('0x' || substr(md5(n || ':' || t), 1, 15) AS BIGINT)) AS VARCHAR) AS hash_sum
    FROM l GROUP BY part""")


def provenance(s, d):
    """Builds of all printed tables are recorded with their fingerprints; one is rebuilt, one never ends."""
    folder, found = new_folder(s, "provenance"), prints(s, d).collect()
    for r in found:
        stats = s.createDataFrame([(1, r["rows"], [])], "tables_created bigint, rows_inserted bigint, tables_skipped array<string>")
        tables.record_build(s, folder, r["table"], str(r["hash_xor"]), f"/{r['table']}", "1")
        if r["table"] != "nation":
            tables.record_build(s, folder, r["table"], str(r["hash_xor"]), f"/{r['table']}", "1", stats)
    known = tables.read_provenance(s, folder)
    return known, known.select("product", F.when(F.col("product") == "orders", "other").otherwise(F.col("source_sha")).alias("source_sha"), "path",
                               F.when(F.col("product") == "region", "2").otherwise(F.col("builder_version")).alias("builder_version"), F.lit(1).alias("file_bytes"))


add("provenance_rows", lambda s, d: provenance(s, d)[0].select("product", "source_sha", "rows", "started"),
    f"""SELECT "table" AS product, CAST(hash_xor AS VARCHAR) AS source_sha, CASE WHEN "table" <> 'nation' THEN rows END AS rows, "table" = 'nation' AS started FROM ({_prints})""")


def reuse(s, d):
    known, wanted = provenance(s, d)
    return tables.reusable(known, wanted).select("product", "source_sha")


add("provenance_reuse", reuse,
    f"""SELECT "table" AS product, CAST(hash_xor AS VARCHAR) AS source_sha FROM ({_prints}) WHERE "table" NOT IN ('orders', 'region', 'nation')""")


def same_source(s, d):
    p = prints(s, d).select(F.col("table").alias("product"), F.col("hash_xor").cast("string").alias("source_sha"), F.concat(F.lit("/"), "table").alias("path"))
    return tables.same_source(p, "orders", "customer", {"orders": "/orders", "customer": "/elsewhere"}).unionByName(
        tables.same_source(p, "orders", "orders", {"orders": "/orders"}))


add("same_source_gate", same_source, f"""WITH p AS ({_prints}), o AS (SELECT hash_xor AS h FROM p WHERE "table" = 'orders'), c AS (SELECT hash_xor AS h FROM p WHERE "table" = 'customer')
    SELECT o.h = c.h AS same_source, false AS paths_ok, false AS allowed FROM o, c UNION ALL SELECT o.h = o.h, true, o.h = o.h FROM o""")


def database_health(s, d):
    c = catalog(s, d)
    checked = people.health(c, {"BIOG_MAIN": ["c_personid", "c_dy"], "ENTRY_DATA": ["c_entry_code", "c_missing"], "NO_TABLE": ["x"]})
    return checked.join(rc.table_counts({t: c[t] for t in ("BIOG_MAIN", "ENTRY_DATA")}), "table", "left")


add("database_health", database_health, with_standins("""
    SELECT 'BIOG_MAIN' AS "table", unnest(['c_personid', 'c_dy']) AS "column", 'ok' AS status, (SELECT count(*) FROM BIOG_MAIN) AS rows
    UNION ALL SELECT 'ENTRY_DATA', unnest(['c_entry_code', 'c_missing']), unnest(['ok', 'missing column']), (SELECT count(*) FROM ENTRY_DATA)
    UNION ALL SELECT 'NO_TABLE', 'x', 'missing table', NULL"""))

# ---- decimals against other numbers: keys above 2^53, which doubles cannot tell apart, fractions, and two scales
_KINDS = {
    "double": ("CAST(9007199254740992 + o_orderkey AS DECIMAL(20,0))", "CAST(9007199254740992 + o_orderkey AS DOUBLE)", "o_orderkey % 2 = 0"),
    "bigint": ("CAST(9007199254740992 + o_orderkey AS DECIMAL(20,0))", "9007199254740992 + o_orderkey", "o_orderkey % 3 = 0"),
    "float": ("CAST(o_orderkey * 0.25 AS DECIMAL(12,2))", "CAST(o_orderkey * 0.5 AS FLOAT)", "o_orderkey < 1000000"),
    "scale": ("CAST(o_orderkey * 0.25 AS DECIMAL(12,2))", "CAST(o_orderkey * 0.125 AS DECIMAL(14,4))", "true"),
}


def diff_decimal_keys(s, d):
    """One diff a kind of key; each side also has a row without a key."""
    out = None
    for kind, (left, right, where) in _KINDS.items():
        a = frame(s, d, f"SELECT {left} AS k, o_orderstatus AS v FROM {{orders}} UNION ALL SELECT NULL, min(o_orderstatus) FROM {{orders}}")
        b = frame(s, d, f"SELECT {right} AS k, o_orderstatus AS v FROM {{orders}} WHERE {where} UNION ALL SELECT NULL, min(o_orderstatus) FROM {{orders}}")
        part = rc.diff(a, b, ["k"]).select(F.lit(kind).alias("kind"), F.col("k").alias("id"), "bucket")
        out = part if out is None else out.unionByName(part)
    return out


def _plain_text(c):
    return f"CASE WHEN contains(CAST({c} AS VARCHAR), '.') THEN rtrim(rtrim(CAST({c} AS VARCHAR), '0'), '.') ELSE CAST({c} AS VARCHAR) END"


add("diff_decimal_keys", diff_decimal_keys, " UNION ALL ".join(f"""
    SELECT '{kind}' AS kind, {_plain_text('coalesce(l.k, r.k)')} AS id,
      CASE WHEN NOT coalesce(r.here, false) THEN 'only_left' WHEN NOT coalesce(l.here, false) THEN 'only_right' WHEN l.v <> r.v THEN 'mismatch' ELSE 'match' END AS bucket
    FROM (SELECT CAST({left} AS DECIMAL(30,4)) AS k, o_orderstatus AS v, true AS here FROM orders UNION ALL SELECT NULL, min(o_orderstatus), true FROM orders) l
    FULL JOIN (SELECT CAST({f"CAST({right} AS BIGINT)" if kind == "double" else right} AS DECIMAL(30,4)) AS k, o_orderstatus AS v, true AS here FROM orders WHERE {where} UNION ALL SELECT NULL, min(o_orderstatus), true FROM orders) r
    ON l.k IS NOT DISTINCT FROM r.k""" for kind, (left, right, where) in _KINDS.items()))

add("ordered_diff_decimal",
    lambda s, d: rc.ordered_diff(frame(s, d, "SELECT CAST(9007199254740992 + o_orderkey AS DECIMAL(20,0)) AS v FROM {orders}"),
                                 frame(s, d, "SELECT CAST(9007199254740992 + o_orderkey AS DOUBLE) AS v FROM {orders}"), ["v"]).select("position", "bucket"),
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS position, CASE WHEN o_orderkey % 2 = 0 THEN 'match' ELSE 'mismatch' END AS bucket FROM orders""")
