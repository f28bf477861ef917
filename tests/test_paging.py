"""Pages from range counts, reports that survive a rewrite, pruned heavy hitters."""
import pytest
from pyspark.sql import functions as F

from prosopo.operators import aggregates as ag, ordering as o, reconcile as rc
from prosopo.operators.paging import paged
from prosopo.plans import people, report_store as store
from tests.conftest import rows


def many(spark, n=2000):
    """Few order values, so most rows tie, some rows are equal, some values NULL."""
    i = F.col("id")
    return spark.range(0, n, 1, 5).select(F.when(i % 11 == 0, None).otherwise(i % 7).alias("a"), (i % 500).alias("b"), F.when(i % 3 > 0, (i % 13).cast("string")).alias("c"))


@pytest.mark.parametrize("order", [["a desc"], ["c", "b desc"], []])
def test_pages_together_are_the_whole(spark, order):
    df, order = many(spark), [F.col(c.split()[0]).desc_nulls_first() if " " in c else F.col(c) for c in order]
    hits = paged(df, order, ranges=6)
    whole = [tuple(r) for r in o.first_rows(df, order, None).collect()]
    assert hits.total == len(whole) == 2000
    for size in (700, 1999):
        got = []
        for at in range(0, 2000, size):
            page = [tuple(r) for r in hits.page(size, at).collect()]
            assert len(page) == min(size, 2000 - at)
            got += page
        assert got == whole
    assert [tuple(r) for r in hits.page(None, 1990).collect()] == whole[1990:]
    assert [tuple(r) for r in hits.page(0, -5).collect()] == whole[:1]
    assert hits.page(10, 2000).count() == 0


def test_a_late_page_reads_and_sorts_two_ranges_at_most(spark):
    hits = paged(many(spark), [F.asc("a")], ranges=8)
    assert len(hits.before) > 4
    for at in (0, 555, 1990):
        met = hits.ranges(10, at)
        assert 1 <= len(met) <= 2
        plan = hits.page(10, at)._jdf.queryExecution().executedPlan().toString()
        assert "(__range#" in plan.split("PartitionFilters: ")[1] and "TakeOrdered" in plan and "Exchange rangepartitioning" not in plan


def test_pages_of_nothing(spark):
    hits = paged(many(spark).where("false"), [F.asc("a")])
    assert hits.total == 0 and hits.page(5).count() == 0 and hits.page(None, 3).count() == 0


def test_search_pages(spark, small):
    hits = people.search_pages(small, None, ranges=3)
    got = [r["person_id"] for at in range(0, 4, 2) for r in people.search_page(small, hits, 2, at).collect()]
    assert got == [1, 2, 3, 4]
    assert rows(people.search_page(small, people.search_pages(small, "nobody"), 5)) == rows(people.search(small, "nobody", limit=5))


def sides(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, x string")
    return a, spark.createDataFrame([(1, "a"), (2, "z"), (None, None)], "id long, x string")


def test_a_rewrite_replaces_its_own_report_only(spark, tmp_path):
    a, b = sides(spark)
    at = str(tmp_path / "s")
    assert store.store_dashboard(spark, at).count() == 0 and store.report_rows(spark, at).count() == 0
    store.store_report(rc.diff(a, b, ["id"]), at, "one", source_sha="0123456789abcdef")
    store.store_report(rc.diff(a, b, ["id"]), at, "two", every_row=True)
    assert store.report_rows(spark, at, "one").count() == 3 and store.report_rows(spark, at, "two").count() == 4
    for _ in range(3):      # both slots are used, then the first again
        store.store_report(rc.diff(a, a, ["id"]), at, "one")
        assert store.report_rows(spark, at, "one").count() == 0 and store.report_rows(spark, at, "two").count() == 4
    assert [(r["query_id"], r["verdict"], r["rows_matching"], r["rows_mismatch"]) for r in store.store_dashboard(spark, at).collect()] == [("one", "PASS", 3, 0), ("two", "FAIL", 1, 1)]
    store.store_report(rc.diff(a, b, ["id"]), at, "one")
    assert rows(store.report_rows(spark, at, "one").select(F.col("key")["id"], "bucket")) == [(None, "only_right"), ("2", "mismatch"), ("3", "only_left")]


def test_a_report_ended_half_way_is_not_seen(spark, tmp_path):
    a, b = sides(spark)
    at = str(tmp_path / "s")
    store.store_rows(rc.diff(a, b, ["id"]), at, "new", "lost", 0)       # its manifest row was never written
    assert store.report_rows(spark, at).count() == 0 and store.store_dashboard(spark, at).count() == 0
    store.store_report(rc.diff(a, b, ["id"]), at, "new")
    store.store_rows(rc.diff(a, a, ["id"]), at, "new", "lost", 1, every_row=True)
    assert sorted(r["bucket"] for r in store.report_rows(spark, at).collect()) == ["mismatch", "only_left", "only_right"]
    store.store_report(rc.diff(b, b, ["id"]), at, "new", every_row=True)
    assert [r["bucket"] for r in store.report_rows(spark, at).collect()] == ["match"] * 3


def facts(spark):
    """Codes 0..5 with 3000 to 500 people, many codes with few; code 77 has many rows of one person, 3 and 4 tie; NULLs on both sides."""
    i = F.col("id")
    big = spark.range(5).join(spark.range(3000).select(i.alias("p")), (F.col("p") < 3000 - 500 * F.least("id", F.lit(3)))).select(i.alias("code"), "p")
    few = spark.range(3000).select((1000 + i % 600).alias("code"), (i % 41).alias("p"))
    hot = spark.range(5000).select(F.lit(77).cast("bigint").alias("code"), F.lit(1).cast("bigint").alias("p"))
    nulls = spark.range(100).select(F.when(i % 2 == 0, i + 1000).alias("code"), F.when(i % 4 > 1, i).alias("p"))
    return big.union(few).union(hot).union(nulls).union(big.where("p % 2 = 0"))


@pytest.mark.parametrize("n", [1, 4, 7, 50, 5000])
def test_pruned_heavy_hitters_are_exact(spark, n):
    df = facts(spark)
    want = [tuple(r) for r in ag.top_codes(df, "code", "p", n).collect()]
    assert [tuple(r) for r in ag.top_codes_pruned(df, "code", "p", n).collect()] == want
    texts = df.select("code", F.concat(F.lit("p"), "p").alias("p"))
    assert [tuple(r) for r in ag.top_codes_pruned(texts, "code", "p", n, lg=10).collect()] == want


def test_pruned_codes_send_no_people(spark):
    """Of all (code, person) pairs only those of codes that can be among the first are grouped."""
    seen = []
    real = ag.cut_lineage
    ag.cut_lineage = lambda df, name, *a, **k: seen.append((name, out := real(df, name, *a, **k))) or out
    try:
        ag.top_codes_pruned(facts(spark), "code", "p", 3).collect()
    finally:
        ag.cut_lineage = real
    counted = {r["__c"] for name, t in seen if name == "code-counts" for r in t.collect()}
    assert {0, 1, 2} <= counted and len(counted) <= 6 and 77 not in counted
    bounds = next(t for name, t in seen if name == "code-bounds")
    exact = facts(spark).groupBy(F.col("code").alias("__c")).agg(F.countDistinct("p").alias("n"))
    assert bounds.join(exact, "__c").where("__most < n").count() == 0


def test_pruned_without_facts(spark):
    assert ag.top_codes_pruned(facts(spark).where("false"), "code", "p", 3).count() == 0
