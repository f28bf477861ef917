"""Kinship, networks and the place hierarchy."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.standins import catalog, with_standins
from prosopo.operators import graph
from prosopo.plans import profile

QUERIES = {}
ORACLES = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def kin(s, d):
    c = catalog(s, d)
    return graph.kin_edges(c["KIN_DATA"], c["KINSHIP_CODES"])


WALK = """
    , e AS (SELECT k.c_personid AS p, k.c_kin_id AS k, coalesce(c.c_upstep, 0) AS u, coalesce(c.c_dwnstep, 0) AS d,
                   coalesce(c.c_marstep, 0) AS m, coalesce(c.c_colstep, 0) AS l
            FROM KIN_DATA k LEFT JOIN KINSHIP_CODES c ON c.c_kincode = k.c_kin_code),
    direct AS (SELECT DISTINCT p AS seed, k, u, d, m, l FROM e),
    walk AS (
      SELECT seed, k, u, d, m, l, 1 AS hop FROM direct WHERE k <> seed AND u <= 2 AND d <= 2 AND m <= 1 AND l <= 1
      UNION
      SELECT w.seed, e.k, w.u + e.u, w.d + e.d, w.m + e.m, w.l + e.l, w.hop + 1
      FROM walk w JOIN e ON e.p = w.k
      WHERE e.k <> w.seed AND w.u + e.u <= 2 AND w.d + e.d <= 2 AND w.m + e.m <= 1 AND w.l + e.l <= 1 AND w.hop < 11),
    states AS (
      SELECT seed, k, u, d, m, l, 1 AS hop, false AS derived FROM direct
      UNION ALL
      SELECT seed, k, u, d, m, l, min(hop), true FROM walk
      WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.seed = walk.seed AND x.k = walk.k AND x.u = walk.u AND x.d = walk.d
                        AND x.m = walk.m AND x.l = walk.l)
      GROUP BY seed, k, u, d, m, l)"""
OUT = """seed AS seed_id, k AS kin_person_id, u AS up_step, d AS down_step, m AS marriage_step, l AS collateral_step, hop, derived AS is_derived"""
add("kinship_states", lambda s, d: graph.expand_kinship(kin(s, d), best_only=False).drop("path"),
    with_standins(f"{WALK} SELECT {OUT} FROM states", recursive=True))
add("kinship_expanded", lambda s, d: graph.expand_kinship(kin(s, d)).drop("path"),
    with_standins(f"""{WALK} SELECT {OUT} FROM states QUALIFY row_number() OVER (PARTITION BY seed, k
        ORDER BY derived, u + d + m + l, hop, u, d, m, l) = 1""", recursive=True))

add("person_kinships_expanded", lambda s, d: profile.expanded_kin(catalog(s, d), catalog(s, d)["BIOG_INST_DATA"].select("c_personid"))
    .drop("kinship", "notes", "source", "pages"),
    with_standins(f"""{WALK}, best AS (SELECT * FROM states WHERE seed IN (SELECT c_personid FROM BIOG_INST_DATA)
        QUALIFY row_number() OVER (PARTITION BY seed, k ORDER BY derived, u + d + m + l, hop, u, d, m, l) = 1)
    SELECT seed AS owner_id, k AS kin_person_id, b.c_name_chn AS kin_name_chn, b.c_name AS kin_name, derived AS is_derived,
      u AS up_step, d AS down_step, m AS marriage_step, l AS collateral_step FROM best LEFT JOIN BIOG_MAIN b ON b.c_personid = best.k""", recursive=True))


def direct_contained(s, d):
    """Direct kin that the expansion lacks; from it the kin of every fifth person are taken out first."""
    from prosopo.operators.reconcile import missing_keys
    direct = kin(s, d).select(F.col("person_id").alias("seed_id"), "kin_person_id")
    return missing_keys(direct, graph.expand_kinship(kin(s, d)).where("seed_id % 5 <> 0"), ["seed_id", "kin_person_id"])


add("direct_kin_within_expanded", direct_contained, with_standins(
    "SELECT DISTINCT CAST(c_personid AS BIGINT) AS seed_id, CAST(c_kin_id AS BIGINT) AS kin_person_id FROM KIN_DATA WHERE c_personid % 5 = 0"))


def reduced(s, d):
    c = catalog(s, d)
    rules = c["KINSHIP_CODES"].where("c_kincode <> 4").select(
        F.col("c_kincode").alias("code1"), F.lit(4).alias("code2"), (F.col("c_kincode") * 10 + 4).alias("code"))
    paths = c["KIN_DATA"].select("c_personid", "c_kin_id", "c_kin_code", F.array("c_kin_code", F.lit(4)).alias("path"))
    return graph.reduce_relation(paths, rules).select("c_personid", "c_kin_id", "c_kin_code", "reduced_code")


add("kin_code_reduction", reduced, with_standins("""
    SELECT f.c_personid, f.c_kin_id, f.c_kin_code, CASE WHEN c.c_kincode IS NOT NULL AND f.c_kin_code <> 4 THEN f.c_kin_code * 10 + 4 END AS reduced_code
    FROM KIN_DATA f LEFT JOIN KINSHIP_CODES c ON c.c_kincode = f.c_kin_code"""))


def all_edges(s, d):
    c = catalog(s, d)
    return c["KIN_DATA"].select(F.col("c_personid").alias("from_id"), F.col("c_kin_id").alias("to_id")).union(
        c["ASSOC_DATA"].select("c_personid", "c_assoc_id"))


def assoc_edges(s, d):
    return catalog(s, d)["ASSOC_DATA"].select(F.col("c_personid").alias("from_id"), F.col("c_assoc_id").alias("to_id"))


EDGES = """, e AS (SELECT DISTINCT c_personid AS a, c_kin_id AS b FROM KIN_DATA WHERE c_kin_id IS NOT NULL AND c_kin_id <> c_personid
             UNION SELECT DISTINCT c_personid, c_assoc_id FROM ASSOC_DATA WHERE c_assoc_id <> c_personid)"""
add("network_expanded", lambda s, d: graph.expand_network(all_edges(s, d), catalog(s, d)["BIOG_INST_DATA"].select("c_personid"), 2),
    with_standins(f"""{EDGES}, seeds AS (SELECT DISTINCT c_personid AS s FROM BIOG_INST_DATA)
    SELECT seed_id, person_id, min(hop) AS hop FROM (
      SELECT s AS seed_id, s AS person_id, 0 AS hop FROM seeds
      UNION ALL SELECT s, b, 1 FROM seeds JOIN e ON a = s
      UNION ALL SELECT s, e2.b, 2 FROM seeds JOIN e ON a = s JOIN e e2 ON e2.a = e.b) GROUP BY 1, 2"""))
add("degrees", lambda s, d: graph.degrees(catalog(s, d)["KIN_DATA"], "c_personid", "c_kin_id"),
    with_standins("""SELECT person_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM (
        SELECT c_personid AS person_id, 1 AS o, 0 AS i FROM KIN_DATA UNION ALL SELECT c_kin_id, 0, 1 FROM KIN_DATA)
        WHERE person_id IS NOT NULL GROUP BY 1"""))
add("neighbours", lambda s, d: graph.neighbours(catalog(s, d)["ASSOC_DATA"], catalog(s, d)["BIOG_INST_DATA"], "c_personid", "c_personid"),
    with_standins("SELECT * FROM ASSOC_DATA WHERE c_personid IN (SELECT c_personid FROM BIOG_INST_DATA)"))


def links(s, d):
    c = catalog(s, d)
    return graph.links_between(assoc_edges(s, d), c["BIOG_INST_DATA"].select("c_personid"), c["BIOG_SOURCE_DATA"].select("c_personid"))


add("links_between_sets", links, with_standins("""
    , e AS (SELECT DISTINCT c_personid AS f, c_assoc_id AS t FROM ASSOC_DATA WHERE c_assoc_id IS NOT NULL),
    a AS (SELECT DISTINCT c_personid AS p FROM BIOG_INST_DATA), b AS (SELECT DISTINCT c_personid AS p FROM BIOG_SOURCE_DATA),
    two AS (SELECT x.f AS s, x.t AS mid, y.t AS g FROM e x JOIN e y ON y.f = x.t
            WHERE x.f IN (SELECT p FROM a) AND y.t IN (SELECT p FROM b) AND x.f <> y.t AND x.f <> x.t AND y.f <> y.t)
    SELECT f AS from_id, t AS to_id, 1 AS link_order, CAST(NULL AS BIGINT) AS middle_id FROM e WHERE f IN (SELECT p FROM a) AND t IN (SELECT p FROM b)
    UNION SELECT s, mid, 2, mid FROM two UNION SELECT mid, g, 2, mid FROM two"""))
add("pair_paths", lambda s, d: graph.pair_paths(assoc_edges(s, d), catalog(s, d)["KIN_DATA"].select(
        F.col("c_personid").alias("a_id"), F.col("c_kin_id").alias("b_id")).where("b_id is not null")),
    with_standins("""
    , e AS (SELECT DISTINCT c_personid AS f, c_assoc_id AS t FROM ASSOC_DATA WHERE c_assoc_id <> c_personid),
    w AS (SELECT DISTINCT c_personid AS a_id, c_kin_id AS b_id FROM KIN_DATA WHERE c_kin_id IS NOT NULL)
    SELECT a_id, b_id, EXISTS (SELECT 1 FROM e WHERE f = a_id AND t = b_id) AS direct,
      (SELECT count(*) FROM e x JOIN e y ON y.f = x.t WHERE x.f = a_id AND y.t = b_id AND x.t <> a_id AND x.t <> b_id) AS middle_count FROM w"""))
add("association_paths", lambda s, d: graph.paths_of_pairs(assoc_edges(s, d), catalog(s, d)["KIN_DATA"].select(
        F.col("c_personid").alias("a_id"), F.col("c_kin_id").alias("b_id")).where("b_id is not null")),
    with_standins("""
    , e AS (SELECT DISTINCT c_personid AS f, c_assoc_id AS t FROM ASSOC_DATA WHERE c_assoc_id <> c_personid),
    w AS (SELECT DISTINCT c_personid AS a_id, c_kin_id AS b_id FROM KIN_DATA WHERE c_kin_id IS NOT NULL)
    SELECT a_id, CAST(NULL AS BIGINT) AS middle_id, b_id, 1 AS link_order FROM w JOIN e ON f = a_id AND t = b_id
    UNION ALL SELECT a_id, x.t, b_id, 2 FROM w JOIN e x ON x.f = a_id JOIN e y ON y.f = x.t AND y.t = b_id WHERE x.t <> a_id AND x.t <> b_id"""))
add("place_closure", lambda s, d: graph.descendants(catalog(s, d)["ADDR_BELONGS_DATA"], catalog(s, d)["ADDR_CODES"].select("c_addr_id"), per_root=True),
    with_standins("""
    , below(root, id, depth) AS (SELECT c_addr_id, c_addr_id, 0 FROM ADDR_CODES
      UNION SELECT root, h.c_addr_id, depth + 1 FROM below JOIN ADDR_BELONGS_DATA h ON h.c_belongs_to = below.id)
    SELECT root, id, min(depth) AS depth FROM below GROUP BY 1, 2""", recursive=True))

# chains of a hundred persons, each above the next
CHAIN = "SELECT c_personid AS c_addr_id, c_personid - 1 AS c_belongs_to FROM {BIOG_MAIN} WHERE c_personid % 100 <> 0"


def chain_closure(s, d):
    c = catalog(s, d)
    return graph.descendants(s.sql(CHAIN, BIOG_MAIN=c["BIOG_MAIN"]), c["BIOG_MAIN"].select("c_personid"), per_root=True)


add("chain_closure", chain_closure, with_standins("""
    SELECT a.c_personid AS root, b.c_personid AS id, CAST(b.c_personid - a.c_personid AS INT) AS depth
    FROM BIOG_MAIN a JOIN BIOG_MAIN b ON a.c_personid // 100 = b.c_personid // 100 AND a.c_personid <= b.c_personid"""))
