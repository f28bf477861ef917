import random

import pytest
from pyspark.sql import functions as F

from prosopo.operators import reconcile as rc
from prosopo.plans import report
from tests.conftest import rows


def stats(df):
    return tuple(df.first())[:6] + (df.first()["matches"],)


def frame(spark, data, schema="id long, x string"):
    return spark.createDataFrame(data, schema)


def test_each_bucket(spark):
    a = frame(spark, [(10, "oak"), (11, "elm"), (12, None), (13, None)])
    b = frame(spark, [(13, None), (11, "ash"), (14, "fir"), (10, "oak")])
    got = rc.diff(a, b, ["id"])
    assert rows(got.select("id", "bucket")) == [(10, "match"), (11, "mismatch"), (12, "only_left"), (13, "match"), (14, "only_right")]
    assert {r["id"]: [tuple(x) for x in r["differing"]] for r in got.collect() if r["differing"]} == {11: [("x", "elm", "ash")]}
    assert stats(rc.diff_stats(got)) == (4, 4, 2, 1, 1, 1, False)


def test_empty_sides_pass_with_zero_counts(spark):
    e = frame(spark, [])
    assert stats(rc.diff_stats(rc.diff(e, e, ["id"]))) == (0, 0, 0, 0, 0, 0, True)


def test_two_part_keys_and_chosen_columns(spark):
    a = frame(spark, [(7, 0, "red", 1), (7, 1, "red", 2), (8, 0, None, 3)], "shelf long, place int, colour string, size int")
    b = frame(spark, [(7, 0, "red", 9), (8, 0, None, 3), (7, 1, "blue", 2), (8, 1, "red", 4)], "shelf long, place int, colour string, size int")
    assert stats(rc.diff_stats(rc.diff(a, b, ["shelf", "place"], ["colour"]))) == (3, 4, 2, 0, 1, 1, False)
    assert stats(rc.diff_stats(rc.diff(a, b, ["shelf", "place"], ["size"]))) == (3, 4, 2, 0, 1, 1, False)
    assert stats(rc.diff_stats(rc.diff(a, b, ["shelf", "place"]))) == (3, 4, 1, 0, 1, 2, False)


def test_null_keys_match_and_missing_columns_read_as_null(spark):
    a = frame(spark, [(None, "a"), (1, None)])
    b = frame(spark, [(None,), (1,)], "id long")
    assert rows(rc.diff(a, b, ["id"]).select("id", "bucket")) == [(None, "mismatch"), (1, "match")]


def test_values_compare_by_kind(spark):
    a = spark.createDataFrame([(1, 36, "36", float("nan"), 2 ** 53 + 1, True)], "id int, n int, t string, f double, big long, b boolean")
    b = spark.createDataFrame([(1.0, 36.0, 36, None, float(2 ** 53), 1)], "id double, n double, t int, f double, big double, b int")
    got = rc.diff(a, b, ["id"]).first()
    assert sorted(x["field"] for x in got["differing"]) == ["big", "t"]


def test_text_and_number_keys_never_match(spark):
    a, b = frame(spark, [("36", "a")], "id string, x string"), frame(spark, [(36, "a")])
    assert rows(rc.diff(a, b, ["id"]).select("id", "bucket")) == [("number:36", "only_right"), ("text:36", "only_left")]


def test_whole_keys_against_real_ones_are_exact(spark):
    a = frame(spark, [(2 ** 53, "a"), (2 ** 53 + 1, "b"), (7, "c"), (None, "d")])
    b = frame(spark, [(float(2 ** 53), "a"), (7.0, "c"), (7.5, "e"), (None, "d")], "id double, x string")
    assert rows(rc.diff(a, b, ["id"]).select("id", "bucket")) == [
        (None, "match"), ("7", "match"), ("7.5", "only_right"), ("9007199254740992", "match"), ("9007199254740993", "only_left")]


def test_truth_values_against_numbers(spark):
    a, b = frame(spark, [(True, "a"), (False, "b")], "id boolean, x string"), frame(spark, [(1, "a"), (2, "c")], "id int, x string")
    assert rows(rc.diff(a, b, ["id"]).select("id", "bucket")) == [(0, "only_left"), (1, "match"), (2, "only_right")]


def test_a_kept_row_of_repeated_keys_needs_one_shuffle(spark):
    a = frame(spark, [(k % 3, k % 2, f"v{k}") for k in range(30)], "id int, n int, x string")
    plan = rc.diff(a, a, ["id"], on_duplicate="last", order_by=["n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert stats(rc.diff_stats(rc.diff(a, a, ["id"], on_duplicate="last", order_by=["n"]))) == (3, 3, 3, 0, 0, 0, True)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_one_edit_among_ties_is_one_mismatch(spark, keys):
    data = [(1, 5, x) for x in "hgfedcba"] + [(1, 9, "z"), (1, 9, "z")]
    a = frame(spark, data, "g int, o int, x string")
    b = frame(spark, [(g, float(o), "edited" if x == "d" else x) for g, o, x in reversed(data)], "g long, o double, x string")
    got = rc.ordered_diff(a, b, ["o"], keys=keys, ignore=() if keys else ("g",))
    assert stats(rc.diff_stats(got)) == (10, 10, 9, 0, 0, 1, False)


def test_ordered_diff_wants_the_same_columns(spark):
    a, b = frame(spark, [(1, "a")]), frame(spark, [(1, "a", 2)], "id long, x string, more int")
    with pytest.raises(ValueError, match="more"):
        rc.ordered_diff(a, b, ["id"])
    assert stats(rc.diff_stats(rc.ordered_diff(a, b, ["id"], ignore=["more"]))) == (1, 1, 1, 0, 0, 0, True)


def test_many_variants(spark):
    sets = {f"v{i}": frame(spark, [(k, "") for k in range(i % 7)]).select("id") for i in range(70)}
    got = {(r["variant"], r["in_variant"]): (r["size"], r["overlap"]) for r in rc.containment(sets, ["id"]).collect()}
    assert len(got) == 4900 and got["v69", "v6"] == (6, 6) and got["v6", "v65"] == (6, 2) and got["v63", "v6"] == (0, 0)


def test_duplicates_are_an_error_unless_told(spark):
    a = frame(spark, [(1, "old", 1), (1, "new", 2)], "id long, x string, n int")
    b = frame(spark, [(1, "new", 2)], "id long, x string, n int")
    with pytest.raises(ValueError, match="not unique"):
        rc.diff(a, b, ["id"])
    with pytest.raises(ValueError, match="order_by"):
        rc.diff(a, b, ["id"], on_duplicate="last")
    assert rc.diff_stats(rc.diff(a, b, ["id"], on_duplicate="last", order_by=["n"])).first()["matches"]
    assert not rc.diff_stats(rc.diff(a, b, ["id"], on_duplicate="first", order_by=["n"])).first()["matches"]


def test_random_perturbation(spark):
    r = random.Random(4)
    left = {(r.choice([None, *range(60)]), r.randrange(5)): r.choice([None, "a", "b"]) for _ in range(200)}
    right = {k: (v if r.random() > .2 else "zz") for k, v in left.items() if r.random() > .1}
    right[(1000, 1)] = "q"
    make = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "a int, b int, v string")
    got = {(x[0], x[1]): x[2] for x in rows(rc.diff(make(left), make(right), ["a", "b"]).select("a", "b", "bucket"))}
    expected = {k: "only_left" if k not in right else "only_right" if k not in left else "match" if left[k] == right[k] else "mismatch"
                for k in set(left) | set(right)}
    assert got == expected


def test_ordered_diff_finds_length_and_order(spark):
    a, b = frame(spark, [(1, "a"), (2, "b"), (3, "c")]), frame(spark, [(1, "a"), (2, "x")])
    got = rc.ordered_diff(a, b, ["id"])
    assert rows(got.select("position", "bucket")) == [(1, "match"), (2, "mismatch"), (3, "only_left")]


def test_schema_diff(spark):
    a, b = frame(spark, []), frame(spark, [], "id int, y string")
    assert rows(rc.schema_diff(a, b)) == [("id", "type", "bigint", "int"), ("x", "only_left", "string", None), ("y", "only_right", None, "string")]
    assert rows(rc.schema_diff(a, b, known_gaps=["x", "y", "id"])) == []


def test_row_counts_are_case_sensitive(spark):
    one, two = frame(spark, [(1, "a")]), frame(spark, [(1, "a"), (2, "b")])
    got = rc.count_diff({"A": one, "B": one, "C": one}, {"a": one, "B": two, "C": one})
    assert rows(got) == [("A", 1, None, "only_left"), ("B", 1, 2, "mismatch"), ("C", 1, 1, "match"), ("a", None, 1, "only_right")]


def test_subset_and_key_sets(spark):
    a, b = frame(spark, [(1, "a"), (None, "b")]), frame(spark, [(None, "b"), (1, "a"), (2, "c")])
    assert rows(rc.missing_keys(a, b, ["id"])) == []
    assert rows(rc.missing_keys(b, a, ["id"])) == [(2,)]


def test_documented_divergence(spark):
    a, b = frame(spark, [(1, "a"), (2, "b"), (3, "c"), (5, "e")]), frame(spark, [(3, "c"), (4, "d"), (5, "x")])
    known = frame(spark, [(1,), (3,), (5,)], "id long")
    got = rc.documented_divergence(rc.diff(a, b, ["id"]), known, ["id"])
    assert rows(got) == [(2, "undocumented"), (3, "not observed"), (4, "only_right"), (5, "mismatch"), (5, "not observed")]


def test_a_diff_with_a_missing_column_can_be_stored(spark, tmp_path):
    a, b = frame(spark, [(1, "a")]), frame(spark, [(1,)], "id long")
    report.write_report(rc.diff(a, b, ["id"], with_rows=True), str(tmp_path), "q")
    assert spark.read.parquet(f"{tmp_path}/q/rows").first()["left_row"]["x"] == "a"


def test_report_keeps_notes_and_skips_broken_files(spark, tmp_path):
    a, b = frame(spark, [(1, "a"), (2, "b")]), frame(spark, [(1, "a")])
    folder = str(tmp_path)
    report.write_report(rc.diff(a, b, ["id"]), folder, "q1", source_sha="f" * 64)
    (tmp_path / "q1" / "hypothesis.md").write_text("notes")
    report.write_report(rc.diff(a, a, ["id"]), folder, "q2")
    report.write_report(rc.diff(a, b, ["id"]), folder, "q1", source_sha="f" * 64)
    (tmp_path / "q3" / "stats").mkdir(parents=True)
    (tmp_path / "q3" / "stats" / "part.json").write_text("{ broken")
    (tmp_path / "q4" / "stats").mkdir(parents=True)
    (tmp_path / "q4" / "stats" / "part.json").write_text('{"query_id": "q4"}')
    got = report.dashboard(report.read_reports(spark, f"{folder}/*/stats"))
    assert [tuple(r)[:8] for r in got.drop("generated").collect()] == [("q1", "FAIL", 2, 1, 1, 1, 0, 0), ("q2", "PASS", 2, 2, 2, 0, 0, 0)]
    assert [r["source"] for r in got.collect()] == ["f" * 12, "(none)"]
    assert (tmp_path / "q1" / "hypothesis.md").read_text() == "notes"
    assert spark.read.parquet(f"{folder}/q1/rows").count() == 1


def test_reports_with_other_side_names(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "diff.json").write_text(
        '{"query_id": "x", "generated_at": "2026-05-28T10:00:00.123", "datadump_sha": null,\n'
        ' "stats": {"rows_a": 3, "rows_b": 2, "rows_matching": 2, "rows_only_in_a": 1, "rows_only_in_b": 0, "rows_value_mismatch": 0, "matches": false}}')
    got = report.dashboard(report.read_reports(spark, f"{tmp_path}/*/diff.json", "a", "b")).first()
    assert tuple(got) == ("x", "FAIL", 3, 2, 2, 1, 0, 0, "(none)", "2026-05-28T10:00:00")


def test_decimal_keys_against_other_numbers(spark):
    from decimal import Decimal as D
    from pyspark.sql import functions as F
    from prosopo.operators import reconcile as rc
    big = 2 ** 53
    frame = lambda values, kind: spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"k {kind}, v int")
    found = lambda a, b: sorted((r["k"], r["bucket"]) for r in rc.diff(a, b, ["k"], compare=[]).where("k is not null").collect())
    wide = frame([D(big), D(big + 1), D(7), D(0), None], "decimal(20,0)")
    assert found(wide, frame([float(big), 7.0, -0.0, None], "double")) == sorted([(str(big), "match"), (str(big + 1), "only_left"), ("7", "match"), ("0", "match")])
    assert found(wide, frame([big, big + 1, 7], "bigint")) == sorted([(str(big), "match"), (str(big + 1), "match"), ("7", "match"), ("0", "only_left")])
    places = frame([D("0.50"), D("0.10"), D("1.00"), D("2.25")], "decimal(10,2)")
    assert found(places, frame([D("0.5000"), D("1"), D("2.2501")], "decimal(12,4)")) == [("0.1", "only_left"), ("0.5", "match"), ("1", "match"), ("2.25", "only_left"), ("2.2501", "only_right")]
    assert found(places, frame([0.5, 0.1, 1.0], "float")) == [("0.1", "match"), ("0.5", "match"), ("1", "match"), ("2.25", "only_left")]
    assert found(places, frame([0.1, 1e25, 1e-30, float("inf")], "double")) == sorted(
        [("0.1", "match"), ("0.5", "only_left"), ("1", "only_left"), ("2.25", "only_left"), ("10000000000000000000000000", "only_right"), ("1.0E-30", "only_right"), ("Infinity", "only_right")])
    # values, too: 2^53 + 1 is not the double 2^53
    a = spark.createDataFrame([(1, D(big + 1)), (2, D(big)), (3, None)], "k int, v decimal(20,0)")
    b = spark.createDataFrame([(1, float(big)), (2, float(big)), (3, None)], "k int, v double")
    assert sorted((r["k"], r["bucket"]) for r in rc.diff(a, b, ["k"]).collect()) == [(1, "mismatch"), (2, "match"), (3, "match")]
    same = rc.ordered_diff(a.select("v"), b.select("v"), ["v"])
    assert sorted(r["bucket"] for r in same.collect()) == ["match", "match", "mismatch"]
