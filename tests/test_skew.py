"""A third of all rows on one key: results stay whole, and adaptive execution can split the hot key."""
import pytest
from pyspark.sql import functions as F

from prosopo import Catalog
from prosopo.operators import joins as j, ordering as o
from prosopo.plans import code_queries as cq
from tests.conftest import rows

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.shuffle.partitions": "16",
}
N = 30_000


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, n=N, name="k"):
    """n rows; key 7 holds a third of them."""
    i = F.col("id")
    return spark.range(0, n, 1, 8).select(F.when(i % 3 == 0, 7).otherwise(100 + i % 2000).cast("bigint").alias(name), i.alias("v"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_matches_of_the_fan_out_join(skewed):
    left = skewed.range(0, 2200).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    out = j.expand(left, hot(skewed), ["k"], "n", large=1000)
    assert "skew=true" in final_plan(out)
    got = out.agg(F.count(F.lit(1)), F.count("v"), F.max("n"), F.countDistinct("v")).first()
    matched = hot(skewed).where("k < 2200").count()
    lonely = left.join(hot(skewed), "k", "left_anti").count()
    assert tuple(got) == (matched + lonely, matched, N // 3, matched)


def test_hot_person_in_a_code_query(skewed):
    facts = hot(skewed, name="c_personid").select("c_personid", F.lit(1).alias("c_status_code"), F.col("v").cast("int").alias("c_sequence"),
                                                 F.col("v").alias("c_source"))
    people = skewed.range(0, 3000).select(F.col("id").alias("c_personid"), F.lit("n").alias("c_name"), F.lit("m").alias("c_name_chn"),
                                          F.lit(1000).alias("c_index_year"), F.lit(1).alias("c_dy"), F.lit(1).cast("bigint").alias("c_index_addr_id"),
                                          F.lit(1).alias("c_female"))
    codes = skewed.createDataFrame([(1, "a", None)], "c_status_code int, c_status_desc string, c_status_desc_chn string")
    c = Catalog({"BIOG_MAIN": people, "STATUS_DATA": facts, "STATUS_CODES": codes})
    out = cq.status_query(c, cq.status_request(limit=None))
    assert "skew=true" in final_plan(out)
    assert out.count() == N and out.where("person_id = 7").count() == N // 3


def test_hot_key_positions_cover_every_row(skewed):
    out = o.with_ordinal(hot(skewed), ["k"], [F.col("v").desc()], "n", large=1000)
    got = out.where("k = 7").agg(F.min("n"), F.max("n"), F.countDistinct("n"), F.sum(F.when(F.col("n") == 1, F.col("v")))).first()
    assert tuple(got) == (1, N // 3, N // 3, N - 3)
    assert out.count() == N


def test_hot_key_top_rows_are_pruned_before_the_shuffle(skewed):
    out = o.top_per_key(hot(skewed), ["k"], [F.col("v").asc()], 5, "n")
    plan = final_plan(out)
    assert plan.count("WindowGroupLimit") == 2
    assert rows(out.where("k = 7").select("v")) == [(0,), (12,), (3,), (6,), (9,)]
