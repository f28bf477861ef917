import pytest
from pyspark.sql import functions as F

from prosopo.operators import aggregates as ag
from prosopo.plans import code_queries as cq, people, profile
from prosopo.plans.relations import ACCESSORS, DETAIL, ENTRY, OFFICE, POSTING, STATUS
from prosopo.session import ALL_KEYS, cut_lineage
from tests.conftest import rows


def test_record_shapes():
    assert (len(ENTRY.fields), len(OFFICE.fields), len(STATUS.fields), len(POSTING.fields)) == (36, 65, 36, 50)
    assert len(DETAIL) + len(ag.RELATION_COUNTS) == 34
    assert {k: len(v.fields) for k, v in ACCESSORS.items()} == {
        "addresses": 26, "altnames": 9, "writings": 12, "entries": 25, "statuses": 14, "possessions": 15, "events": 18,
        "associations": 41, "sources": 8, "institutions": 21}


def test_entry_order_labels_and_defaults(small):
    got = cq.entry_query(small, cq.entry_request(sort=True)).select("person_id", "entry_code", "entry_method", "entry_year", "sequence", "entry_xy_count", "sex", "dynasty")
    assert [tuple(r) for r in got.collect()] == [
        (2, "7", "", 1090, 1, 3, "M", "宋"), (1, "36", "exam", None, 0, 3, "F", "宋"), (1, "36", "exam", 1010, 1, 3, "F", "宋"),
        (3, "36", "exam", 1010, 2, 0, "Unknown", None)]
    all_rows = cq.entry_query(small, cq.entry_request(limit=None))
    assert rows(all_rows) == rows(cq.entry_query(small, cq.entry_request()))


def test_unknown_dynasty_gives_no_rows(small):
    assert cq.entry_query(small, cq.entry_request(dynasty_ids=[77])).count() == 0


def test_office_fan_out(small):
    got = cq.office_query(small, cq.office_request(sort=True))
    assert [tuple(r) for r in got.select("posting_id", "office", "sequence", "office_address_id", "office_place_count", "office_xy_count").collect()] == [
        (100, "Prefect", 1, 10, 1, 3), (101, "Prefect", 0, 10, 3, 3), (101, "Prefect", 0, 11, 3, 3), (101, "Prefect", 0, 12, 3, 0),
        (102, "cheng", 1, None, 0, 0)]
    years = cq.office_query(small, cq.office_request(use_office_year_range=True, office_year_from=1012, office_year_to=1004, limit=None))
    assert {r["posting_id"] for r in years.collect()} == {100, 101}
    assert cq.office_query(small, cq.office_request(limit=2)).count() == 2


def test_requests_that_cannot_be_honoured(small):
    with pytest.raises(NotImplementedError, match="fact_years"):
        cq.status_query(small, cq.CodeRequest(fact_years=(1, 2)))
    with pytest.raises(NotImplementedError, match="places"):
        cq.status_query(small, cq.CodeRequest(places=[1]))
    with pytest.raises(NotImplementedError):
        people.place_query(small, [1], ["moon"])
    with pytest.raises(ValueError):
        profile.related_items(small, "pets", None, 3)


def test_status_by_person_place(small):
    got = cq.status_query(small, cq.status_request(place_ids=[20], include_subordinate_units=True, limit=None))
    assert rows(got.select("person_id", "sequence", "status")) == [(1, 1, "士"), (2, 0, "士")]


def test_altname_ties_are_stable(small):
    got = profile.accessor(small, "altnames").where("owner_id = 1").orderBy("ordinal")
    assert [(r["ordinal"], r["source_id"]) for r in got.collect()] == [(1, 1), (2, 2)]


def test_direct_kin(small):
    got = profile.direct_kin(small).select("owner_id", "ordinal", "kin_person_id", "kinship", "kin_name", "up_step", "is_derived")
    assert rows(got) == [(1, 1, None, "父 F", None, 1, False), (1, 2, 2, "父 F", "Bo", 1, False), (1, 3, 77, "S", None, 0, False),
                         (2, 1, 1, "S", "Ann", 0, False)]
    assert rows(profile.direct_kin(small, keep_orphans=False).select("owner_id", "ordinal", "kin_person_id")) == [(1, 1, 2), (2, 1, 1)]


def test_expanded_kin(small):
    got = profile.expanded_kin(small).select("owner_id", "kin_person_id", "kinship", "is_derived", "up_step", "down_step", "notes")
    assert rows(got) == [
        (1, None, "父 F", False, 1, 0, None), (1, 2, "父 F", False, 1, 0, None), (1, 77, "S", False, 0, 1, None),
        (2, 1, "S", False, 0, 1, None), (2, 77, "S > S", True, 0, 2, "2/2")]


def test_nested_postings_round_trip(small):
    offices = set()
    for part_offices, part_addresses in ((1, 1), (1, 2), (2, 100), (100, 100)):
        nested = profile.nested_postings(small, part_offices=part_offices, part_addresses=part_addresses)
        assert rows(profile.flatten_postings(nested).select("posting_id", "addr_id")) == [(100, 10), (101, 10), (101, 11), (101, 12), (102, None)]
        # an office cut in several address parts is still one office
        offices.add(sum(o["address_part"] == 0 for r in nested.collect() for o in r["offices"]))
        assert all(len(r["offices"]) <= part_offices and all(len(o["addresses"]) <= part_addresses for o in r["offices"]) for r in nested.collect())
    assert offices == {3}


def test_detail_of_unknown_id(small, spark):
    ids = spark.createDataFrame([(1,), (12345,)], "id long")
    got = profile.detail(small, ids, ("c_dy",)).collect()
    assert len(got) == 1 and len(got[0]) == 35
    assert (got[0]["entry_count"], got[0]["kin_count"], got[0]["event_count"], got[0]["gender"]) == (2, 3, 0, "F")
    assert [tuple(f) for f in got[0]["fields"]] == [("c_dy", "15")]


def test_group_without_flags_is_empty(small, spark):
    ids = spark.createDataFrame([(1,)], "id long")
    parts = profile.group_people(small, ids)
    assert set(parts) == {"status", "office", "entry", "texts", "addresses"}
    assert all(p.count() == 0 for p in parts.values())
    index = profile.group_people(small, ids, include_addresses=True, address_mode=profile.INDEX_ADDRESSES)["addresses"]
    assert [r["addr_id"] for r in index.collect()] == [10]


def test_search_pages_and_caps(small):
    assert people.search(small, None).count() == 4 and people.search(small, None, limit=0).count() == 1
    with pytest.raises(ValueError, match="cap"):
        people.search(small, None, limit=5, cap=4)
    assert [r["person_id"] for r in people.search(small, None, limit=2, offset=1).collect()] == [2, 3]


def test_histogram_keeps_null(small):
    assert rows(ag.histogram(small["BIOG_MAIN"], "c_female")) == [(None, 1), (0, 2), (1, 1)]


def test_bracket_of_nothing(small):
    assert ag.dynasty_bracket(small["DYNASTIES"], [1234]).count() == 0
    assert tuple(ag.dynasty_bracket(small["DYNASTIES"], [15, 6]).first()) == (6, 15, 618, 1279)


def test_plans_stay_in_the_jvm_and_push_filters_down(spark, tmp_path, small):
    from prosopo import Catalog
    for name in small:
        small[name].write.parquet(f"{tmp_path}/{name}")
    stored = Catalog.from_folder(spark, str(tmp_path), list(small))
    plan = cq.entry_query(stored, cq.entry_request(entry_codes=[36], use_entry_year_range=True, entry_year_from=900, entry_year_to=1100, limit=None)
                          )._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "c_entry_code" in line and "= 36)" in line]
    assert any("Filter" in line and ">= 900)" in line for line in filters) and "PushedFilters: [" in plan
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    top = cq.entry_query(stored, cq.entry_request(entry_codes=[36], limit=5)). _jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_postings_are_dealt_once_by_person(small, spark, monkeypatch):
    """Labels and persons are joined before the placed rows are written, by one deal of them; no row is shuffled for either afterwards."""
    placed = []

    def keep(df, name="step", **options):
        out = cut_lineage(df, name, **options)
        if name == "placed":
            placed.append((out.columns, df._jdf.queryExecution().executedPlan().toString()))
        return out
    monkeypatch.setattr(cq, "cut_lineage", keep)
    extra = small["BIOG_MAIN"].withColumn("c_unused", F.lit("long text that no field shows"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows(cq.office_query(small.with_tables(BIOG_MAIN=extra), cq.office_request()))
        monkeypatch.setattr(cq, "LARGE_GROUP_ROWS", 0)      # every person owns too much: the fan-out is dealt by all its keys
        assert rows(cq.office_query(small, cq.office_request())) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (columns, plan), (_, hot) = placed
    assert {"__label", "b_c_name"} <= set(columns) and not {"b_c_unused", "b_c_personid"} & set(columns)
    assert "hashpartitioning(c_posting_id" not in plan and "hashpartitioning(c_posting_id" in hot
    assert spark.conf.get(ALL_KEYS, None) in (None, "true")
    out = cq.office_query(small, cq.office_request())._jdf.queryExecution().executedPlan().toString()
    assert not any(f"hashpartitioning({c}" in out for c in ("c_office_id", "c_personid", "c_posting_id"))
