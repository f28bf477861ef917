import random

from pyspark.sql import functions as F

from prosopo.operators import graph as g
from tests.conftest import rows

STEPS = {1: (1, 0, 0, 0), 2: (0, 1, 0, 0), 3: (0, 0, 1, 0), 4: (0, 0, 0, 1), 5: (3, 0, 0, 0), 6: (0, 0, 0, 0)}
CAPS = (2, 2, 1, 1)


def fixture(spark, n=40, m=120):
    r = random.Random(11)
    edges = [(r.randrange(n), None if r.random() < .05 else (0 if r.random() < .3 else r.randrange(n)), r.randrange(1, 8)) for _ in range(m)]
    kin = spark.createDataFrame(edges, "c_personid long, c_kin_id long, c_kin_code int")
    codes = spark.createDataFrame([(c, *s) for c, s in STEPS.items()], "c_kincode int, c_upstep int, c_dwnstep int, c_marstep int, c_colstep int")
    return edges, g.kin_edges(kin, codes)


def brute(edges):
    """All states by plain breadth-first search: {(seed, kin, vector): (derived, hop)}."""
    out, links = {}, {}
    for p, k, c in edges:
        out[(p, k, STEPS.get(c, (0, 0, 0, 0)))] = (False, 1)
        if k is not None:
            links.setdefault(p, set()).add((k, STEPS.get(c, (0, 0, 0, 0))))
    ok = lambda v: all(a <= b for a, b in zip(v, CAPS))
    frontier = {s for s in out if s[1] is not None and s[1] != s[0] and ok(s[2])}
    for hop in range(2, 12):
        found = set()
        for seed, kin, v in frontier:
            for k, w in links.get(kin, ()):
                state = (seed, k, tuple(a + b for a, b in zip(v, w)))
                if k != seed and ok(state[2]) and state not in out:
                    found.add(state)
        out.update({s: (True, hop) for s in found})
        frontier = found
    return out


def test_kinship_states_equal_a_plain_search(spark):
    edges, kin = fixture(spark)
    got = {(r["seed_id"], r["kin_person_id"], tuple(r[s] for s in g._STEPS)): (r["is_derived"], r["hop"])
           for r in g.expand_kinship(kin, best_only=False).collect()}
    assert got == brute(edges)


def test_kinship_invariants(spark):
    edges, kin = fixture(spark)
    got = g.expand_kinship(kin).collect()
    pairs = [(r["seed_id"], r["kin_person_id"]) for r in got]
    assert len(pairs) == len(set(pairs))
    assert {(p, k) for p, k, _ in edges} <= set(pairs)
    for r in got:
        if r["is_derived"]:
            assert all(r[s] <= c for s, c in zip(g._STEPS, CAPS)) and r["seed_id"] != r["kin_person_id"]
        assert len(r["path"]) == r["hop"]
    assert rows(g.expand_kinship(kin)) == sorted((tuple(r) for r in got), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_seeds_restrict_without_changing_answers(spark):
    _, kin = fixture(spark)
    seeds = spark.createDataFrame([(0,), (3,)], "id long")
    every = [r for r in rows(g.expand_kinship(kin)) if r[0] in (0, 3)]
    assert rows(g.expand_kinship(kin, seeds)) == every


def test_reduction_by_automaton_and_by_joins_agree(spark):
    rng = random.Random(4)
    rules = spark.createDataFrame([(a, b, rng.randrange(9)) for a in range(9) for b in range(9) if rng.random() < 0.8] + [(None, 1, 2), (1, None, 2)], "code1 int, code2 int, code int")
    data = [(i, [rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 8, None]) for _ in range(rng.randrange(7))]) for i in range(400)] + [(400, None), (401, [])]
    kin = spark.createDataFrame(data, "id long, path array<int>")
    folded, joined = g.reduce_relation(kin, rules), g.reduce_relation(kin, rules, most=10)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(folded) and "Join" in plan(joined)
    assert rows(folded.select("id", "reduced_code")) == rows(joined.select("id", "reduced_code"))
    assert folded.columns == joined.columns
    wide = spark.createDataFrame([(1, [2, 3])], "id long, path array<bigint>")
    assert rows(g.reduce_relation(wide, spark.createDataFrame([(2, 3, 5)], "code1 int, code2 int, code int")).select("reduced_code")) == [(5,)]
    assert rows(g.reduce_relation(wide, rules.where("false")).select("reduced_code")) == [(None,)]
    twice = spark.createDataFrame([(2, 3, 5), (2, 3, 6)], "code1 int, code2 int, code int")
    assert rows(g.reduce_relation(wide, twice).select("reduced_code")) == [(5,), (6,)]


def test_reduction_stops_where_a_rule_is_missing(spark):
    kin = spark.createDataFrame([(1, [1]), (2, [1, 2]), (3, [1, 2, 3]), (4, [1, 9])], "id int, path array<int>")
    rules = spark.createDataFrame([(1, 2, 12), (12, 3, 123)], "code1 int, code2 int, code int")
    assert rows(g.reduce_relation(kin, rules).select("id", "reduced_code")) == [(1, 1), (2, 12), (3, 123), (4, None)]


def test_network_equals_a_plain_search(spark):
    r = random.Random(5)
    edges = [(r.randrange(30), r.choice([0, r.randrange(30)])) for _ in range(80)]
    df = spark.createDataFrame(edges, "from_id long, to_id long")
    got = set(rows(g.expand_network(df, spark.createDataFrame([(1,), (2,), (55,)], "id long"), 3)))
    expected = set()
    for s in (1, 2, 55):
        dist, frontier = {s: 0}, {s}
        for hop in (1, 2, 3):
            frontier = {b for a, b in edges if a in frontier} - set(dist)
            dist.update({b: hop for b in frontier})
        expected |= {(s, p, h) for p, h in dist.items()}
    assert got == expected


def test_links_and_pairs_equal_brute_force(spark):
    r = random.Random(9)
    edges = {(r.randrange(25), r.choice([3, r.randrange(25)])) for _ in range(90)}
    df = spark.createDataFrame(sorted(edges), "from_id long, to_id long")
    a, b = list(range(8)), list(range(5, 14))
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    expected = {(x, y, 1, None) for x, y in edges if x in a and y in b}
    for x, m in edges:
        for m2, y in edges:
            if m == m2 and x in a and y in b and x != y and x != m and m != y:
                expected |= {(x, m, 2, m), (m, y, 2, m)}
    assert set(rows(g.links_between(df, ids(a), ids(b)))) == expected
    pairs = [(x, y) for x in range(12) for y in range(12) if x != y]
    got = {(p, q): (d, n) for p, q, d, n in rows(g.pair_paths(df, spark.createDataFrame(pairs, "a_id long, b_id long")))}
    for p, q in pairs:
        mids = {m for x, m in edges if x == p and m not in (p, q) and (m, q) in edges}
        assert got[(p, q)] == ((p, q) in edges, len(mids))


def test_closure_with_cycle(small, spark):
    got = g.descendants(small["ADDR_BELONGS_DATA"], [20, 10], per_root=True)
    assert set(rows(got)) == {(20, 20, 0), (20, 10, 1), (20, 21, 1), (20, 11, 2), (10, 10, 0)}


def test_degrees_ignore_missing_ends(small):
    assert rows(g.degrees(small["KIN_DATA"], "c_personid", "c_kin_id")) == [(1, 3, 1, 4), (2, 1, 1, 2), (77, 0, 1, 1)]


def test_paths_of_given_pairs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (1, 3), (3, 3), (5, 1), (1, 5)], "from_id long, to_id long")
    pairs = spark.createDataFrame([(1, 3), (1, 2), (5, 3), (9, 1), (1, 1)], "a_id long, b_id long")
    got = rows(g.paths_of_pairs(edges, pairs).select("a_id", "middle_id", "b_id", "link_order"))
    assert got == sorted([(1, None, 3, 1), (1, None, 2, 1), (1, 2, 3, 2), (1, 4, 3, 2), (5, 1, 3, 2), (1, 5, 1, 2)],
                         key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_kinship_says_where_the_rounds_ended_it(spark):
    steps = "up_step int, down_step int, marriage_step int, collateral_step int"
    chain = [(i, i + 1, 1, 0, 0, 0, 0) for i in range(1, 20)] + [(50, 51, 1, 0, 0, 0, 0)]
    edges = spark.createDataFrame(chain, f"person_id long, kin_person_id long, kin_code int, {steps}")
    seeds = spark.createDataFrame([(1,), (15,), (50,)], "id long")
    got = g.expand_kinship(edges, seeds, with_complete=True).groupBy("seed_id").agg(F.count("*").alias("n"), F.min("complete").alias("c"))
    assert rows(got) == [(1, 11, False), (15, 5, True), (50, 1, True)]


def test_closure_by_doubling(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)], "above long, below long")
    pairs, rounds = g.closure(chain)
    assert rounds <= 10
    assert pairs.agg(F.count("*"), F.count_if(F.col("depth") == F.col("below") - F.col("above")), F.max("depth")).first()[:] == (125250, 125250, 500)
    r = random.Random(4)
    edges = [(r.randrange(20), r.choice([None, r.randrange(20), r.randrange(20)])) for _ in range(45)] + [(3, 3), (None, 1)]
    pairs, _ = g.closure(spark.createDataFrame(edges, "above int, below int"))
    expected = set()
    for s in range(20):
        dist, frontier, depth = {s: 0}, {s}, 0
        while frontier:
            depth += 1
            frontier = {b for a, b in edges if a in frontier and b is not None} - set(dist)
            dist.update({b: depth for b in frontier})
        expected |= {(s, b, d) for b, d in dist.items() if b != s}
    assert rows(pairs) == sorted(expected, key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert rows(g.closure(spark.createDataFrame([], "above long, below long"))[0]) == []


def test_known_states_are_not_exchanged(spark):
    """In each round of the kinship and network loops the written rounds and links are read in their buckets."""
    from prosopo.operators import graph
    plans, write = [], graph.bucketed_and_count

    def keep(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args)
    steps = "up_step int, down_step int, marriage_step int, collateral_step int"
    kin = spark.createDataFrame([(i, i + 1, 1, 1, 0, 0, 0) for i in range(9)], f"person_id long, kin_person_id long, kin_code int, {steps}")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    graph.bucketed_and_count = keep
    try:
        assert graph.expand_kinship(kin, caps=graph.KinCaps(up=4)).count() == 9 + 8 + 7 + 6
        graph.expand_network(kin.select(F.col("person_id").alias("from_id"), F.col("kin_person_id").alias("to_id")), kin.select("person_id"), 4).count()
    finally:
        graph.bucketed_and_count = write
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    # a round more is a bucketed scan more and no exchange more
    kin_plans = [p for p in plans if "up_step" in p]
    for part in (kin_plans, [p for p in plans if "up_step" not in p]):
        scans, exchanges = [p.count("Bucketed: true") for p in part], [p.count("Exchange") for p in part]
        assert len(part) >= 3 and scans == [scans[0] + i for i in range(len(part))] and set(exchanges) == {exchanges[0]} and exchanges[0] <= 2
