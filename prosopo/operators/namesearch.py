"""Many name searches at once, over postings of character n-grams.

A keyword is looked up by its rarest n-gram: one character for a keyword of one, two for one of two, three else. Postings are made
only of n-grams that some keyword holds, from each different name once; names found are verified. So names and keywords never
meet all with all, and a common n-gram costs only the keywords that have no rarer one.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prosopo.session import cut_lineage

LONGEST = 3
WHOLE = r"^[+-]?[0-9]+$"


def grams(c: Column, n: int) -> Column:
    """The different runs of ``n`` characters of a string."""
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def name_rows(person: DataFrame, altname: DataFrame | None, key: str, names: Sequence[str], alt_names: Sequence[str]) -> DataFrame:
    """(person_id, name) of all main and alternative names, in lower case; alternative names only of persons that exist."""
    def of(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
        return [df.select(F.col(key).cast("bigint").alias("person_id"), F.lower(c).alias("name")) for c in columns if c in df.columns]
    parts = of(person, names)
    if altname is not None:
        known = person.select(F.col(key).alias("__known"))
        parts += of(altname.join(known, F.col(key) == F.col("__known"), "left_semi"), alt_names)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("name is not null and person_id is not null").distinct()


def persons_by_keywords(person: DataFrame, altname: DataFrame | None, keywords: DataFrame, key: str = "c_personid",
                        names: Sequence[str] = ("c_name_chn", "c_name"), alt_names: Sequence[str] = ("c_alt_name_chn", "c_alt_name")) -> DataFrame:
    """(keyword_id, person_id) of every hit of (keyword_id, keyword): for each keyword what one search finds.

    An integer finds that id; other text is looked up anywhere in main and alternative names, case-insensitively. A blank or NULL
    keyword is no filter, so it gives no row here: the caller knows that it means everybody.
    """
    asked = keywords.select("keyword_id", F.trim("keyword").alias("text")).where("text <> ''")
    number = F.col("text").rlike(WHOLE)
    numbers = asked.where(number).select("keyword_id", F.col("text").try_cast("bigint").alias("person_id"))
    by_number = numbers.join(person.select(F.col(key).cast("bigint").alias("person_id")), "person_id").select("keyword_id", "person_id")
    # keywords alike but for their case are looked up once
    texts = cut_lineage(asked.where(~number).select("keyword_id", F.lower("text").alias("text")), "keywords")
    n = F.least(F.length("text"), F.lit(LONGEST))
    held = cut_lineage(texts.select("text").distinct().withColumn("gram", F.explode(
        F.when(n == 1, grams(F.col("text"), 1)).when(n == 2, grams(F.col("text"), 2)).otherwise(grams(F.col("text"), 3)))), "keyword-grams")
    named = cut_lineage(name_rows(person, altname, key, names, alt_names), "names")
    posted = (named.select("name").distinct()
              .withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(*(grams(F.col("name"), k) for k in range(1, LONGEST + 1)))))))
              .join(held.select("gram").distinct(), "gram", "left_semi"))
    posted = cut_lineage(posted, "postings")
    sizes = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a keyword one of whose n-grams no name holds finds nothing
    rarest = (held.join(sizes, "gram", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
              .where("r.n > 0").select("text", F.col("r.gram").alias("gram")))
    found = posted.join(rarest, "gram").where(F.contains("name", "text")).select("text", "name")
    by_name = texts.join(found, "text").join(named, "name").select("keyword_id", "person_id").distinct()
    return by_name.union(by_number.distinct())
