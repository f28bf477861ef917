"""Comparison by checksums: the rows and counters of the plain diff, with little read."""
import random

import pytest
from pyspark.sql import functions as F

from prosopo.operators import checksums as cs, reconcile as rc
from tests.conftest import rows


def both(left, right, keys, compare, bits, stored=None):
    compare = [c for c in left.columns if c not in keys] if compare is None else compare
    found, stats = cs.checksum_diff(*(stored or [cs.checksummed(d, keys, compare, bits=bits) for d in (left, right)]))
    plain = rc.diff(left, right, keys, compare)
    text = lambda d: rows(d.select(*[F.col(k).cast("string") for k in keys], "bucket", F.to_json("differing")))
    assert text(found) == text(plain.where("bucket <> 'match'"))
    assert tuple(stats.first()) == tuple(rc.diff_stats(plain).first())
    return found, stats


@pytest.mark.parametrize("bits", [0, 3, 7])
def test_equals_the_plain_diff(spark, bits):
    rng = random.Random(bits)
    value = lambda: rng.choice([None, 0.5, -0.0, 0.0, float("nan"), 7.0, 1e300])
    data = [(i if i else None, rng.choice("ab"), value(), rng.choice([None, "x", ""])) for i in range(600)]
    other = [(None if r[0] is None else float(r[0]), *r[1:]) if rng.random() < 0.9 else (None if r[0] is None else float(r[0]), r[1], value(), "y") for r in data if rng.random() < 0.95]
    both(spark.createDataFrame(data, "id long, part string, v double, t string"), spark.createDataFrame(other + [(9999.0, "a", 1.0, "n")], "id double, part string, v double, t string"),
         ["id", "part"], None, bits)


def test_kinds_of_numbers(spark):
    """Floats, doubles, decimals and truth values as keys and values, with keys that lie in other leaves than their equals."""
    i = F.col("id")
    kinds = {"float": (i / 4).cast("float"), "double": i / 4, "decimal(12,2)": (i / 4).cast("decimal(12,2)"), "decimal(20,6)": (i / 4).cast("decimal(20,6)")}
    sides = {n: spark.range(40).select(c.alias("k"), (i % 3 / 10).cast(n).alias("v"), (i % 2).cast("boolean").alias("b")) for n, c in kinds.items()}
    sides["whole"] = spark.range(12).select(i.alias("k"), i.cast("int").alias("v"), (i % 2).cast("int").alias("b"))
    stored = {n: cs.checksummed(d, ["k"], bits=3) for n, d in sides.items()}
    for a, b in (("float", "float"), ("float", "double"), ("float", "decimal(12,2)"), ("double", "decimal(20,6)"), ("decimal(12,2)", "decimal(20,6)"), ("whole", "double"), ("whole", "decimal(12,2)")):
        both(sides[a], sides[b], ["k"], None, 3, [stored[a], stored[b]])


def test_empty_sides_and_missing_columns(spark):
    empty = spark.createDataFrame([], "id long, x string")
    some = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    for left, right in ((empty, empty), (empty, some), (some, empty), (some, some.select("id")), (some.select("id"), some)):
        both(left, right, ["id"], ["x"], 5)
    texts = spark.createDataFrame([("1", "a"), ("2", None)], "id string, x string")
    both(some, texts, ["id"], ["x"], 5)


def test_repeated_keys_are_refused_and_a_table_is_opened_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id long, x string")
    with pytest.raises(ValueError, match="not unique"):
        cs.checksummed(df, ["id"], folder=str(tmp_path / "bad"))
    with pytest.raises(Exception):      # its description was never written
        cs.read_checksummed(spark, str(tmp_path / "bad"))
    good = cs.checksummed(df, ["id", "x"], folder=str(tmp_path / "good"), bits=4)
    again = cs.read_checksummed(spark, str(tmp_path / "good"))
    assert cs.unequal_leaves(good, again) == []
    with pytest.raises(ValueError, match="same keys"):
        cs.unequal_leaves(good, cs.checksummed(df, ["id", "x"], bits=5))


def records_read(spark):
    """Input records of the stages that are known, by number."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).inputRecords() for i in range(stages.size())}


def test_ten_keys_of_many_read_a_tenth_of_the_rows(spark):
    n = 100_000
    left = spark.range(n).select("id", (F.col("id") * 7).alias("v"))
    right = left.withColumn("v", F.when(F.col("id") % 10_000 == 17, -1).otherwise(F.col("v")))
    a, b = cs.checksummed(left, ["id"], bits=10), cs.checksummed(right, ["id"], bits=10)
    before = records_read(spark)
    found, stats = cs.checksum_diff(a, b)
    assert rows(found.select("id")) == sorted([(17 + 10_000 * i,) for i in range(10)], key=lambda r: (True, str(r[0])))
    assert tuple(stats.first())[:6] == (n, n, n - 10, 0, 0, 10)
    read = sum(n for stage, n in records_read(spark).items() if stage > max(before))
    assert 0 < read < 2 * n / 10, read
