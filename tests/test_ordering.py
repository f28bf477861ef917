import random

import pytest
from pyspark.sql import functions as F

from prosopo.operators import ordering as o
from tests.conftest import rows


def data(spark, hot_share=0.35, n=3000):
    r = random.Random(7)
    out = [(1 if r.random() < hot_share else r.randrange(2, 40), r.choice([None, *range(6)]), i) for i in range(n)]
    out += [(None, 3, n + i) for i in range(20)]
    return out, spark.createDataFrame(out, "k long, v int, id long").repartition(7)


def brute(out, by_key=True):
    expected, seen = [], {}
    for k, v, i in sorted(out, key=lambda x: ((x[0] is not None, x[0] or 0) if by_key else 0, (x[1] is not None, x[1] or 0), x[2])):
        key = k if by_key else None
        seen[key] = seen.get(key, 0) + 1
        expected.append((k, v, i, seen[key]))
    return sorted(expected, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("large", [10, 500, 1_000_000])
def test_ordinals_do_not_depend_on_the_path_taken(spark, large):
    out, df = data(spark)
    got = o.with_ordinal(df, ["k"], o.nulls_first("v", "id"), "n", large=large)
    assert rows(got) == brute(out)


def test_global_position(spark):
    out, df = data(spark)
    assert rows(o.with_position(df, o.nulls_first("v", "id"), "n")) == brute(out, by_key=False)


def test_positions_of_equal_rows_are_complete(spark):
    df = spark.createDataFrame([(1, 1)] * 500, "k long, v int")
    got = [r["n"] for r in o.with_ordinal(df, ["k"], [F.col("v").asc()], "n", large=10).collect()]
    assert sorted(got) == list(range(1, 501))


def test_top_per_key_beyond_the_group_limit_threshold(spark):
    out, df = data(spark)
    got = o.top_per_key(df, ["k"], o.nulls_first("v", "id"), 1000, "n")
    assert rows(got) == [r for r in brute(out) if r[3] <= 1000]


def test_first_and_last(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (1, 7, "c"), (None, 2, "d"), (None, 1, "e")], "k long, v int, t string")
    assert rows(o.keep_first(df, ["k"], o.nulls_first("v")).select("k", "t")) == [(None, "e"), (1, "b")]
    assert rows(o.keep_last(df, ["k"], ["v"]).select("k", "t")) == [(None, "d"), (1, "c")]


def test_first_per_key_prunes_before_the_shuffle(spark):
    _, df = data(spark)
    plan = o.keep_first(df, ["k"], o.nulls_first("v"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("limit,cap,expected", [(0, 10_000, 1), (-5, None, 1), (50, 10_000, 50), (20_000, None, 20_000)])
def test_row_limit(limit, cap, expected):
    assert o.row_limit(limit, cap) == expected


def test_a_limit_above_the_cap_is_an_error():
    with pytest.raises(ValueError, match="cap"):
        o.row_limit(20_000, 10_000)


@pytest.mark.parametrize("large", [1, 10_000])
def test_ties_are_broken_by_value_whatever_the_group_size(spark, large):
    tied = [(k, 1, t) for k in (1, None) for t in ("d", None, "a", "c", "b")]
    df = spark.createDataFrame(tied, "k long, v int, t string").repartition(4)
    got = o.with_ordinal(df, ["k"], o.nulls_first("v"), "n", large=large).where("k = 1").orderBy("n")
    assert [r["t"] for r in got.collect()] == [None, "a", "b", "c", "d"]
    top = o.top_per_key(df, ["k"], o.nulls_first("v"), 2).where("k = 1")
    assert rows(top.select("t")) == [(None,), ("a",)]
    assert [r["t"] for r in o.keep_last(df, ["k"], ["v"]).where("k = 1").collect()] == ["d"]


def test_pages_over_ties_hold_every_row_once(spark):
    df = spark.createDataFrame([(1, i) for i in range(40)], "v int, id long").repartition(5)
    pages = [r["id"] for at in range(0, 40, 7) for r in o.first_rows(df, o.nulls_first("v"), 7, at).collect()]
    assert pages == list(range(40))
