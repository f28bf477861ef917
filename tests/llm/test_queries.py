"""The registered queries of the corpus operators on the smallest driver data: against SQL where there is some."""
import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import check
from prosopo.llm import queries
from prosopo.session import cut_lineage
from tests.llm.test_texts import closure, cut, encoded, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver data not present")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    ok, message = check(spark, FOLDER, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


def test_embeddings_against_brute_force(spark):
    from tests.llm.test_embeddings import brute
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {r[0]: tuple(r)[1:4] for r in queries.op1_embeddings(spark, FOLDER).collect()} == brute(rows, 0.9)


def test_repeats_against_brute_force(spark, documents):
    assert sorted(tuple(r)[:5] for r in queries.op2_suffix(spark, FOLDER).collect()) == cut([d[:2] for d in documents])


def test_fingerprints_against_brute_force(spark, documents):
    fps = {i: plain_fingerprint(t) for i, t, _ in documents}
    want = closure(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert sorted(map(tuple, queries.op10_simhash(spark, FOLDER).collect())) == sorted((i, f"{fps[i]:016x}", want[i]) for i in fps)


def test_digests_against_the_library(spark, documents):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    assert sorted(map(tuple, queries.op9_bpe(spark, FOLDER).collect())) == sorted((i, *encoded(tok, t)) for i, t, _ in documents)


def test_languages_held_out(spark, documents):
    got = {r.doc_id: r for r in queries.op8_language(spark, FOLDER).collect()}
    lang = {i: x for i, _, x in documents}
    held = [i for i in got if got[i].held_out]
    assert held and sum(got[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)


def test_pipeline_stage_by_stage(spark, documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(cut_lineage(stage(spark, kept[-1], FOLDER), f"test-{name}"))
    assert all(k.columns == names for k in kept[:-1])
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    assert len(ids[1]) >= 0.98 * len(ids[0])                       # clean documents stay
    text = {r[0]: r[1] for r in kept[1].select("doc_id", "text").collect()}
    copies = {}
    for i in sorted(text):
        copies.setdefault(text[i], i)
    assert ids[2] <= set(copies.values())                          # of copies only the first
    left = {i: t for i, t in text.items() if i in ids[2]}
    want = {i: n - gone for i, n, gone, *_ in cut(sorted(left.items()))}
    sizes = {r[0]: r[1] for r in kept[3].select("doc_id", F.octet_length("text")).collect()}
    assert set(sizes) == {i for i in want if want[i] or not left[i]} and all(want[i] - 6 * left[i].count("\n") - 100 <= sizes[i] <= want[i] for i in sizes)
    pieces = kept[4].groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()
    assert {r[0] for r in pieces} == ids[3] and all(r[1] == r[2] for r in pieces)
    run = corpus_pipeline.run(spark, FOLDER)
    assert hashlib.sha256(str(sorted(map(tuple, run.select("doc_id", "start", "length").collect()))).encode()).hexdigest() == hashlib.sha256(
        str(sorted(map(tuple, kept[4].select("doc_id", "start", "length").collect()))).encode()).hexdigest() or run.agg(F.sum("length")).first() == kept[4].agg(F.sum("length")).first()


def test_near_duplicates_with_shared_and_missing_ids(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(3, a), (5, a + " more"), (5, b), (7, b), (None, c), (None, c), (None, d), (9, d), (3, a), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (None, c), (9, d), (4, "")], key=str)
