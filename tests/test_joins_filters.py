import random

import pytest
from pyspark.sql import functions as F

from prosopo.functions import exprs
from prosopo.operators import filters as f, joins as j
from tests.conftest import rows


@pytest.mark.parametrize("large", [20, 1_000_000])
def test_expand_equals_a_left_join_even_for_a_hot_key(spark, large):
    r = random.Random(1)
    left = [(r.choice([None, *range(20)]), i) for i in range(300)]
    right = [(0 if r.random() < .4 else r.choice([None, *range(12, 30)]), i) for i in range(400)]
    a, b = spark.createDataFrame(left, "k long, l long"), spark.createDataFrame(right, "k long, r long")
    expected = []
    for k, l in left:
        hits = [x for y, x in right if y == k and k is not None]
        expected += [(k, l, len(hits), x) for x in hits] or [(k, l, 0, None)]
    assert rows(j.expand(a, b, ["k"], "n", large)) == sorted(expected, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_orphans_include_null_targets(small):
    assert rows(j.orphans(small["KIN_DATA"], small["BIOG_MAIN"])) == [(1, None, 1), (1, 77, 2)]
    assert rows(j.most_orphans(small["KIN_DATA"], small["BIOG_MAIN"])) == [(1, 2)]


def test_zip_shows_misalignment(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "p long, s int, v string")
    b = spark.createDataFrame([(1, 1, "x", 10), (1, 2, "q", 11), (2, 1, "z", 12), (2, 2, "w", 13)], "p long, s int, v string, id int")
    got = j.zip_by_position(a, b, ["p"], [F.asc("s")], [F.asc("s")], ["id"], ["v"])
    assert rows(got.select("p", "ordinal", "id", "zip_ok")) == [(1, 1, 10, True), (1, 2, 11, False), (2, 1, 12, True), (2, 2, 13, False)]


def test_code_lists(small):
    entries = small["ENTRY_DATA"]
    assert f.by_codes(entries, "c_entry_code", ["36", " 7 "], "none").count() == 5
    assert f.by_codes(entries, "c_entry_code", [], "none").count() == 0
    assert f.by_codes(entries, "c_entry_code", [], "all").count() == 5
    with pytest.raises(ValueError):
        f.by_codes(entries, "c_entry_code", ["x36"], "all")
    with pytest.raises(ValueError):
        f.by_codes(entries, "c_entry_code", [], "maybe")


def test_years_may_be_swapped_and_null_is_outside(small):
    assert f.by_years(small["BIOG_MAIN"], "c_index_year", (1100, 1000)).count() == 3
    assert exprs.ordered_bounds(1500, 1200) == (1200, 1500)


def test_subordinate_places_survive_a_cycle(small):
    got = f.by_places(small["ENTRY_DATA"], "c_entry_addr_id", [20], small["ADDR_BELONGS_DATA"], subordinate=True)
    assert got.count() == 4
    assert f.by_places(small["ENTRY_DATA"], "c_entry_addr_id", [], None, subordinate=True).count() == 5


@pytest.mark.parametrize("keyword,ids", [(None, [1, 2, 3, 4]), ("  ", [1, 2, 3, 4]), ("2", [2]), ("子瞻", [1]), ("pol", [2]), ("NOBODY", [4]), ("%", [])])
def test_keyword(small, keyword, ids):
    got = f.persons_by_keyword(small["BIOG_MAIN"], small["ALTNAME_DATA"], keyword)
    assert sorted(r["c_personid"] for r in got.collect()) == ids


def test_radius_is_exact(spark):
    r = random.Random(3)
    spots = [(i, round(r.uniform(-3, 3), 3), round(r.uniform(-3, 3), 3)) for i in range(200)] + [(900, None, 1.0)]
    facts = spark.createDataFrame([(s[0],) for s in spots] + [(None,)], "p long")
    places = spark.createDataFrame(spots, "c_addr_id long, x_coord double, y_coord double")
    got = {x["p"] for x in f.by_radius(facts, "p", places, [0, 1], 0.7).collect()}
    near = {i for i, x, y in spots if x is not None and any((x - cx) ** 2 + (y - cy) ** 2 <= .7 ** 2 for k, cx, cy in spots[:2])}
    assert got == near


def test_system_tables_are_hidden(spark):
    names = spark.createDataFrame([("BIOG_MAIN", "TABLE"), ("sqlite_stat1", "TABLE"), ("MSysObjects", "TABLE"), ("sqliteX", "table"), ("V", "VIEW")],
                                  "name string, type string")
    assert rows(f.user_tables(names).select("name")) == [("BIOG_MAIN",), ("sqliteX",)]


def test_dynasty_bounds_read_null_as_zero(small):
    assert rows(j.dynasty_bounds(small["DYNASTIES"])) == [(15, 15, 960, 1279), (6, 6, 618, 0)]


def test_labels(spark):
    df = spark.createDataFrame([(None, "b"), ("", "b"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(exprs.label(F.col("a"), F.col("b"))).collect()] == ["b", "", None]
    assert [r[0] for r in df.select(exprs.joined_display(F.col("a"), F.col("b"))).collect()] == ["b", " b", None]


def test_range_join_by_aligned_blocks(spark):
    import random
    from prosopo.operators import joins as j
    r = random.Random(8)
    spans = [(i, a, a + r.choice([-1, 0, 1, 7, 300])) for i, a in enumerate(r.randint(-400, 400) for _ in range(60))]
    spans += [(100, None, 5), (101, 5, None), (102, None, None), (103, -50_000, 50_000)]
    years = [r.randint(-500, 500) for _ in range(200)] + [None, 50_000, 50_001, -50_000, -50_001]
    windows = spark.createDataFrame(spans, "id int, lo int, hi int")
    got = sorted((x["y"], x["id"]) for x in j.in_windows(spark.createDataFrame([(y,) for y in years], "y int"), "y", windows, "lo", "hi").collect())
    assert got == sorted((y, i) for y in years for i, lo, hi in spans if None not in (y, lo, hi) and lo <= y <= hi)
    cover = j.dyadic_cover(windows.where("lo is not null and hi is not null"), "lo", "hi").groupBy("id").count()
    assert max(x["count"] for x in cover.collect()) <= 2 * 17       # a window of 100 001 years has 17 binary digits
    doubles = spark.createDataFrame([(5.0,), (5.5,), (float("nan"),)], "y double")
    assert [x["y"] for x in j.in_windows(doubles, "y", spark.createDataFrame([(1, 5, 6)], "id int, lo int, hi int"), "lo", "hi").collect()] == [5.0]
    assert j.in_windows(doubles, "y", windows.where("id = 102"), "lo", "hi").count() == 0


def test_expand_writes_no_sizes_where_no_key_is_large(spark, monkeypatch):
    names, cut = [], j.cut_lineage
    monkeypatch.setattr(j, "cut_lineage", lambda df, name="step": (names.append(name), cut(df, name))[1])
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11), (None, 12), (3, 13)], "k int, w int")
    want = rows(j.expand(a, b, ["k"], "n", 1))
    assert "sizes" in names
    names.clear()
    assert rows(j.expand(a, b, ["k"], "n")) == want
    assert not names


def test_windows_of_many_pairs_are_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(j, "PAIRS", 50)
    df = spark.range(600).selectExpr("id", "case when id % 7 = 0 then null else cast(id % 5 as double) end as y", "map('a', id) as m")
    windows = spark.range(40).selectExpr("id as w", "cast(id % 4 - 1 as int) as lo", "cast(id % 4 + id % 3 as int) as hi")
    got = j.in_windows(df, "y", windows, "lo", "hi")
    want = sorted((i, w) for i in range(600) if i % 7 for w in range(40) if w % 4 - 1 <= i % 5 <= w % 4 + w % 3)
    assert sorted((r["id"], r["w"]) for r in got.collect()) == want
    assert got.columns == ["id", "y", "m", "w", "lo", "hi"]
    assert got.rdd.getNumPartitions() >= 2 * len(want) // 50
