"""URL rules decided by a cascade of Bloom filters, exact over the corpus's keys, without a join.

A rule is a host and a path prefix (``example.org/es/``); it fits that host and its subdomains. The
keys a url could match are its host's suffixes, each with the path's prefixes of the lengths that
rules have. The cascade of a verdict answers "is this key listed?": level 1 encodes the listed keys;
level 2 those keys of the corpus that level 1 lets through wrongly; level 3 the listed keys that
level 2 hides, and so on until a level errs on no key. Since every key of the corpus took part, the
answer is exact for each. A level's bits are a literal in the plan, so judging urls is one pass of
expressions. The first level's error rate is chosen so that the second set is no larger than the list:
bits grow with the list (bounded by ``MAX_LISTED``), not with the corpus.

Rows: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the verdict
for unresolvable urls; other urls without a rule get the default. Every row gives a row, repeated or
not; extra columns are not read.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from prosopo.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LISTED = 200_000    #: listed keys of one verdict, so that a cascade stays a small literal
MAX_LEVELS = 40


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first ``://`` and the path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys a rule with a path of one of ``lengths`` could have to fit, the longest first (ties: the longer host)."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in sorted(lengths, reverse=True))), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct(
        (-F.length(h) - F.length(p)).alias("size"), (-F.length(h)).alias("host_size"), F.concat(h, p).alias("key")))))
    return F.transform(F.array_sort(F.filter(keys, lambda k: k["host_size"] < 0)), lambda k: k["key"])


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` of 64 bits, ``hashes`` positions per key, hashed under ``salt``."""
    bits: int
    hashes: int
    salt: str
    words: tuple[int, ...]


def positions(key: Column, bits: int, hashes: int, salt: str) -> list[Column]:
    a = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(bits))
    b = F.pmod(F.xxhash64(F.lit(salt + "+"), key), F.lit(bits - 1)) + 1
    return [F.pmod(a + i * b, F.lit(bits)) for i in range(hashes)]


def contains(level: Level, key: Column) -> Column:
    words = F.array(*(F.lit(w).cast("long") for w in level.words))
    out = F.lit(True)
    for p in positions(key, level.bits, level.hashes, level.salt):
        out = out & (F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    return out


def encode(keys: DataFrame, n: int, error: float, salt: str) -> Level:
    """A filter of ``n`` keys: positions are set by a grouped bit_or; the driver gets the words, which ``n`` bounds."""
    bits = max(64, math.ceil(-n * math.log(error) / math.log(2) ** 2))
    hashes = max(1, round(-math.log2(error)))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, salt))).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("v"))
    found = {r["w"]: r["v"] for r in words.collect()}
    return Level(bits, hashes, salt, tuple(found.get(i, 0) for i in range(math.ceil(bits / 64))))


def cascade(listed: DataFrame, universe: DataFrame, salt: str) -> list[Level]:
    """The levels for the keys of ``listed`` that are exact on all of ``universe`` (both have a column ``key``)."""
    listed = listed.where("key is not null").distinct()
    n = listed.count()
    if n > MAX_LISTED:
        raise ValueError(f"{n} listed keys; a cascade takes {MAX_LISTED}")
    if n == 0:
        return []
    size = universe.count()
    levels = [encode(listed, n, max(1e-9, min(0.5, math.sqrt(0.5) * n / max(size, 1))), f"{salt}1")]
    wrong = cut_lineage(universe.where(contains(levels[0], F.col("key"))).distinct().join(listed, "key", "left_anti"), "cascade")
    inside, outside = listed, wrong    # what the next level must let through, and what it has to catch
    while (n := outside.count()):
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: two keys share all hashes")
        levels.append(encode(outside, n, 0.5, f"{salt}{len(levels) + 1}"))
        inside, outside = outside, inside.where(contains(levels[-1], F.col("key")))
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Level 1 says yes, unless level 2 says yes, unless level 3 ..."""
    out = F.lit(False)
    for level in reversed(levels):
        out = contains(level, key) & ~out
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
          default: str = "allow", unresolvable: str = "block") -> DataFrame:
    """One row per page: its id, host, path, rule and verdict. ``rules`` are (verdict, host, path prefix); the longest fitting rule wins."""
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules})
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    keyed = parsed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    by_verdict: dict[str, list[Level]] = {}
    for verdict in sorted({v for v, _, _ in rules}):
        listed = spark.createDataFrame([(h + p,) for v, h, p in rules if v == verdict], "key string")
        by_verdict[verdict] = cascade(listed, universe, verdict)
    hits = {v: (lambda k, levels=levels: is_listed(levels, k)) for v, levels in by_verdict.items()}
    judged = keyed.withColumn("hit", F.get(F.filter(F.transform("keys", lambda k: F.struct(k.alias("key"), F.coalesce(
        *(F.when(hit(k), F.lit(v)) for v, hit in hits.items())).alias("verdict"))), lambda h: h["verdict"].isNotNull()), F.lit(0)))
    return judged.select(id_col, "host", "path", F.col("hit.key").alias("rule"), F.coalesce(
        F.col("hit.verdict"), F.when(F.col("host") == "", F.lit(unresolvable)).otherwise(F.lit(default))).alias("verdict"))
