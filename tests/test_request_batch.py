"""Requests in a table against the same requests run one by one; name searches in a table against single searches."""
import pytest
from pyspark.sql import functions as F

from prosopo.operators.filters import persons_by_keyword
from prosopo.operators.namesearch import persons_by_keywords
from prosopo.plans import code_queries as cq
from prosopo.plans.code_queries import CodeRequest
from prosopo.plans.relations import ENTRY, OFFICE, STATUS
from prosopo.plans.request_batch import request_rows, run_requests
from tests.conftest import rows

KEYWORDS = ["ann", "O", "安", "o ", "子", "子瞻", "NOBODY", "nobod", "1", "+2", "99", "丙x", "p", "pole", "no%", "_", "bo"]


def requests():
    entry = {"all": {}, "code": dict(codes=[36]), "codes": dict(codes=["36", 7]), "absent": dict(codes=[1]), "none": dict(on_empty="none"),
             "year": dict(codes=[36], fact_years=(1005, 1095)), "year_turned": dict(fact_years=(1095, 1005), index_years=(1, 2)),
             "index": dict(index_years=(1000, 1050)), "dynasty": dict(dynasty_ids=[15]), "both": dict(index_years=(900, 1200), dynasty_ids=[99]),
             "place": dict(places=[10]), "below": dict(places=[20], include_subordinate_units=True), "code_below": dict(codes=[7], places=[21], include_subordinate_units=True),
             "home": dict(person_places=[10, 12]), "home_below": dict(person_places=[21], include_subordinate_person_units=True, codes=[36]),
             "person_place": dict(places=[11], place_of="person"), "both_places": dict(places=[10], person_places=[10]),
             "word": dict(person_keyword="nn"), "number": dict(person_keyword=" 2 ", codes=[7]), "blank": dict(person_keyword=" "),
             "first": dict(limit=1), "two": dict(limit=2, codes=[36]), "first_below": dict(limit=2, places=[20], include_subordinate_units=True)}
    return {k: CodeRequest(**v) for k, v in entry.items()}


def singles(small, relation, asked):
    out = []
    for name, r in asked.items():
        out += [(name, *map(str, row)) for row in cq.code_query(small, relation, r).collect()]
    return sorted(out)


@pytest.mark.parametrize("relation", [ENTRY, OFFICE, STATUS], ids=lambda r: r.table)
def test_each_request_gives_what_it_gives_alone(small, relation):
    asked = requests()
    if relation is STATUS:
        asked = {k: r for k, r in asked.items() if r.fact_years is None and not (r.places and r.place_of == "fact")}
    if relation is not ENTRY:       # each single run costs some seconds: these relations take the kinds that differ
        asked = {k: r for k, r in asked.items() if k in ("code", "index", "below", "home_below", "person_place", "both_places", "first", "two", "word")}
        codes = {36: 7 if relation is OFFICE else 40, 7: 8}
        asked = {k: CodeRequest(**{**r.__dict__, "codes": [codes.get(int(c), c) for c in r.codes]}) for k, r in asked.items()}
    got = run_requests(small, relation, asked)
    assert sorted((r[0], *map(str, r[1:])) for r in got.collect()) == singles(small, relation, asked)


def test_requests_that_cannot_be_honoured(small, spark):
    with pytest.raises(NotImplementedError, match="fact_years"):
        run_requests(small, STATUS, {"a": CodeRequest(fact_years=(1, 2))})
    with pytest.raises(NotImplementedError, match="places"):
        run_requests(small, STATUS, {"a": CodeRequest(places=[1])})
    with pytest.raises(NotImplementedError, match="unique"):
        run_requests(small, ENTRY, request_rows(spark, {"a": CodeRequest()}).union(request_rows(spark, {"a": CodeRequest()})))
    with pytest.raises(ValueError, match="lacks"):
        run_requests(small, ENTRY, spark.createDataFrame([("a",)], "request_id string"))
    with pytest.raises(ValueError, match="cap"):
        request_rows(spark, {"a": CodeRequest(limit=5, cap=4)})
    with pytest.raises(TypeError):
        request_rows(spark, {"a": CodeRequest(codes=small["ENTRY_CODES"].select("c_entry_code"))})
    assert run_requests(small, ENTRY, request_rows(spark, {"a": CodeRequest()}).where("false")).collect() == []


def test_facts_are_read_once(small, spark, tmp_path):
    from prosopo import Catalog
    for name in small:
        small[name].write.parquet(f"{tmp_path}/{name}")
    stored = Catalog.from_folder(spark, str(tmp_path), list(small))
    from prosopo.plans import request_batch
    plans, cut = [], request_batch.cut_lineage

    def keep(df, name="step"):
        if name == "request-hits":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)
    request_batch.cut_lineage = keep
    try:
        run_requests(stored, ENTRY, requests()).count()
    finally:
        request_batch.cut_lineage = cut
    assert plans[0].count("/ENTRY_DATA]") == 1 and "CartesianProduct" not in plans[0] and "NestedLoop" not in plans[0] and "Python" not in plans[0]


def test_only_persons_asked_for_fan_out(small, monkeypatch):
    from prosopo.plans import request_batch
    seen, expand = [], request_batch.expand
    monkeypatch.setattr(request_batch, "expand", lambda left, *a: seen.append(left) or expand(left, *a))
    homes = {"at": CodeRequest(person_places=[11], dynasty_ids=[15]), "other": CodeRequest(person_places=[10], dynasty_ids=[6]),
             "year": CodeRequest(person_places=[10], index_years=(1, 2))}
    got = run_requests(small, OFFICE, homes).collect()
    assert sorted((r[0], *map(str, r[1:])) for r in got) == singles(small, OFFICE, homes)
    assert {r.c_personid for r in seen[0].collect()} == {2}     # 1 lives at 10, but no request there takes its dynasty or year


def test_named_fields_are_those_of_all(small):
    homes = {"below": CodeRequest(person_places=[20], include_subordinate_person_units=True, limit=2)}
    names = ["office", "office_xy_count", "person_id", "posting_id"]
    some = run_requests(small, OFFICE, homes, names).select(*names)
    assert rows(some) == rows(run_requests(small, OFFICE, homes).select(*names)) != []
    with pytest.raises(ValueError, match="fields"):
        run_requests(small, OFFICE, homes, ["no_field"])


def test_many_name_searches_equal_single_ones(small, spark):
    words = [(f"k{i}", w) for i, w in enumerate(KEYWORDS)] + [("null", None), ("blank", "  "), ("again", "ann")]
    got = rows(persons_by_keywords(small["BIOG_MAIN"], small["ALTNAME_DATA"], spark.createDataFrame(words, "keyword_id string, keyword string")))
    want = {(k, r[0]) for k, w in words if w and w.strip() for r in persons_by_keyword(small["BIOG_MAIN"], small["ALTNAME_DATA"], w).select("c_personid").distinct().collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_name_searches_pair_no_names_with_all_keywords(small, spark):
    from prosopo.operators import namesearch
    words = spark.createDataFrame([("a", "ann"), ("b", "o")], "keyword_id string, keyword string")
    plan = namesearch.persons_by_keywords(small["BIOG_MAIN"], None, words)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert persons_by_keywords(small["BIOG_MAIN"].where("false"), None, words).count() == 0
    assert persons_by_keywords(small["BIOG_MAIN"], None, words.where("false")).count() == 0
    everyone = small["BIOG_MAIN"].withColumn("c_name", F.lit("aaaa"))
    assert persons_by_keywords(everyone, None, words.withColumn("keyword", F.lit("AA"))).count() == 2 * 4
