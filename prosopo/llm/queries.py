"""The registered queries of this subpackage: each applies one operator to its whole table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prosopo.llm import bpe, brown, centroids, langid, licenses, neardup, oracles, packing, resample, simhash, suffixdedup, topk, urlfilter, warc
from prosopo.llm.common import load


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


#: The rules asked for: (verdict, host, path prefix).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(load(spark, sf_dir, "documents")).drop("kept")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(load(spark, sf_dir, "pages"), URL_RULES)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(load(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(
        "id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"))
    return topk.search(vectors, vectors.where(F.pmod("id", F.lit(50)) == 0), k=5).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), end_id=1, special={"<|endoftext|>": 50256})


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, load(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs.where(~F.coalesce(held_out(), F.lit(False))).select("lang", "text"))
    return (langid.identify(docs, model).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
            .select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(7)) == 2
    return brown.score_texts(load(spark, sf_dir, "documents"), held).withColumnRenamed("id", "doc_id")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), percent=25, least_words=20, longest=2, buckets=10_000, seed="7")
    return drawn.withColumnRenamed("id", "doc_id")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.whole_vectors(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", dim=64, scale=1024)
    order = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    placed, found = centroids.cluster(vectors, dim=64, k=8, rounds=10, seed_order=order)
    return centroids.with_inertia(placed, found).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {f.__name__: f for f in (op1_embeddings, op2_suffix, op3_urls, op4_topk, op5_pack, op6_licenses, op7_warc, op8_language, op9_bpe, op10_simhash,
                                   op11_brown, op12_resample, op13_centroids)}
ORACLES = {"op3_urls": oracles.urls(URL_RULES), "op4_topk": oracles.TOPK, "op6_licenses": oracles.license_scan(licenses.BASE, licenses.OWN),
           "op7_warc": oracles.WARC, "op12_resample": oracles.resampled(25, 20, 10_000, "7"), "op13_centroids": oracles.centroids(64, 8, 10, 1024, "3")}
