"""License scan by a positional rare-token index.

A template is a licence sentence with a mandatory key phrase at a known place. The index keeps, per
template, the postings (word, place) of its key phrase's rarest words, by the words' document counts
in the corpus at hand. A file's words that are rare licence words are looked up with their positions;
a template stands where the positions of its rare words agree on one start, and the key phrase is
then verified word for word. The score is the largest share of a found template's words that stand in place.

Everything is array expressions on the file's own row: no join, no shuffle of texts; the only
aggregate counts the templates' words (a vocabulary bounded by the template list).

Rows: null and empty texts have no words and no labels (labels and base_labels are empty strings, first
and last word null, score 0). Every row gives a row; extra columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from prosopo.llm.urlfilter import LOWER, UPPER

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 2     #: rare words of a key phrase that are looked up


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: int          # where the mandatory phrase begins
    size: int         # its words
    base: bool

    @property
    def phrase(self) -> tuple[str, ...]:
        return self.words[self.key:self.key + self.size]


def template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    words, phrase = tuple(text.split()), tuple((key or text).split())
    at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
    return Template(label, words, at, len(phrase), base)


#: The phrases and labels that are asked for.
BASE = (template("mit", "under the mit license", base=True), template("apache-2", "apache license version 2", base=True),
        template("cc-by-nc", "cc by nc", base=True))
#: Opening or grant sentences of common public licences, with the phrase that must stand word for word.
OWN = (
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
             "permission is hereby granted free of charge"),
    template("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses license 2 0"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             "redistribution and use in source and binary forms"),
    template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    template("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
)


def words_of(text: Column) -> Column:
    """The words of a whole text, in order."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS, -1), "")


def rare_words(words: DataFrame, templates: tuple[Template, ...], rare: int = RARE) -> dict[Template, list[str]]:
    """Each template's rarest key words, from the number of documents that hold them."""
    vocabulary = sorted({w for t in templates for w in t.phrase})
    held = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("w"))
    count = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}   # at most the vocabulary
    return {t: sorted(set(t.phrase), key=lambda w: (count.get(w, 0), w))[:rare] for t in templates}


def starts(t: Template, rare: list[str], words: Column, places: Column) -> Column:
    """Where the template stands: starts its rarest word proposes, that its other rare words confirm and the key phrase verifies."""
    first, *others = ([i for i, w in enumerate(t.phrase) if w == word] for word in rare)

    def at(start: Column, i: int) -> Column:
        return F.coalesce(F.get(words, start + F.lit(i)) == F.lit(t.phrase[i]), F.lit(False))

    def confirmed(start: Column) -> Column:
        out = start >= 0
        for i in [i for other in others for i in other] + list(range(t.size)):
            out = out & at(start, i)
        return out

    anchor = F.filter(places, lambda p: F.get(words, p) == F.lit(t.phrase[first[0]]))
    return F.filter(F.transform(anchor, lambda p: p - F.lit(first[0])), confirmed)


def share(t: Template, words: Column, found: Column) -> Column:
    """The largest share of the template's words that stand in place at a found start; 0 if there is none."""
    def one(start: Column) -> Column:
        begin = start - F.lit(t.key)
        hit = sum((F.coalesce((begin + F.lit(i) >= 0) & (F.get(words, begin + F.lit(i)) == F.lit(w)), F.lit(False)).cast("int")
                   for i, w in enumerate(t.words)), F.lit(0))
        return hit / F.lit(float(len(t.words)))
    return F.coalesce(F.array_max(F.transform(found, one)), F.lit(0.0))


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, own: tuple[Template, ...] = OWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = base + own
    words = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("words"))
    rare = rare_words(words, templates)
    anchors = sorted({r[0] for r in rare.values()})
    placed = words.withColumn("places", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(anchors), i))))
    found = placed.select(id_col, F.size("words").cast("long").alias("n_words"), *(
        c for k, t in enumerate(templates) for c in (starts(t, rare[t], F.col("words"), F.col("places")).alias(f"at{k}"),)), "words")
    at = [F.col(f"at{k}") for k in range(len(templates))]
    all_base = F.flatten(F.array(*at[:len(base)]))
    label = lambda some: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(
        *(F.when(F.size(at[k]) > 0, F.lit(templates[k].label)) for k in some))))), ",")
    return found.select(id_col, "n_words", F.size(all_base).cast("long").alias("n_base"),
                        F.array_min(all_base).cast("long").alias("first_word"), F.array_max(all_base).cast("long").alias("last_word"),
                        label(range(len(base))).alias("base_labels"), label(range(len(templates))).alias("labels"),
                        F.greatest(*(share(t, F.col("words"), at[k]) for k, t in enumerate(templates))).alias("score"))
