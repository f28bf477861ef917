"""Language identification by interpolated Kneser-Ney character models, one per language.

A model is trained on at most ``TRAIN_DOCS`` different whole texts per language, chosen by a hash of the
text (a bounded sample: a documented parameter), and calibrated on other texts. The n-grams of all languages lie in one sorted array of hashes with one row of log probabilities
per hash and a column per language; contexts lie in a second one with their back-off weights. A text is
scored by whole arrays: the longest known n-gram at each character, then the back-off chain for the
few that are unknown. The language with the lowest cross-entropy per character wins; a text whose
cross-entropy lies above what the calibration documents of its length showed is marked rejected.

Runs of anything but letters count as one blank, so markup and digits do not decide.

Rows: null texts and texts without a letter are ``und`` (score 0, rejected). Every row gives a row;
repeated ids, empty tables and extra columns are fine. Without any training document all are ``und``.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from prosopo.llm.common import texts

ORDER = 4
TRAIN_DOCS = 600        #: documents per language the models are counted on, at most
CALIBRATION_DOCS = 400  #: further documents per language the rejection is calibrated on, at most
SLICE = 400_000         #: characters scored at once
LENGTHS = (0, 40, 200, 1000)   #: rejection is calibrated apart for these least lengths
MARGIN = 1.0            #: nats a character above the highest calibration value before a text is rejected
START = "\x02"
_OTHER = re.compile(r"[\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` codes; entry i is the run that ends at i (from n - 1)."""
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ codes[k:len(codes) - n + 1 + k]) * _MUL
        h ^= h >> np.uint64(29)
    return h


def plain(text: str) -> str:
    """What is scored: lower case, each run of anything but letters a single blank."""
    return _OTHER.sub(" ", text.lower())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


@dataclass
class Model:
    """The sorted arrays. ``languages`` are in column order."""
    languages: list[str]
    order: int
    grams: np.ndarray      # sorted hashes of all n-grams, of every order
    logp: np.ndarray       # (gram, language) log probability of the last character after the others
    contexts: np.ndarray   # sorted hashes of contexts
    backoff: np.ndarray    # (context, language) log weight given to the lower order
    floor: float           # log probability of a character never seen
    limits: dict[str, list[float]]

    def score(self, text_list: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood by text and language, number of characters by text)."""
        n_chars = np.array([len(t) for t in text_list], np.int64)
        total = np.zeros((len(text_list), len(self.languages)))
        group, size = [], 0
        for i, t in enumerate(text_list):
            group.append(i)
            size += len(t)
            if size >= SLICE or i + 1 == len(text_list):
                self._add(text_list, group, total)
                group, size = [], 0
        return total, n_chars

    def _add(self, text_list: list[str], group: list[int], total: np.ndarray) -> None:
        pad = START * (self.order - 1)
        codes = codes_of("".join(pad + text_list[i] for i in group))
        lengths = np.array([len(text_list[i]) for i in group])
        owner = np.repeat(np.arange(len(group)), lengths + len(pad))
        starts = np.cumsum(lengths + len(pad)) - lengths
        is_char = np.ones(len(codes), bool)
        for k in range(1, len(pad) + 1):
            is_char[starts - k] = False
        for at in range(len(pad), len(codes), SLICE):
            end = min(at + SLICE, len(codes))
            values = self._logp(codes[at - len(pad):end])
            keep = is_char[at:end]
            for column in range(len(self.languages)):
                total[group, column] += np.bincount(owner[at:end][keep], values[keep, column], len(group))

    def _find(self, table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return at, table[at] == h

    def _logp(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of codes[order - 1:], from the longest known n-gram down."""
        n = len(codes) - self.order + 1
        out = np.zeros((n, len(self.languages)), np.float32)
        todo = np.arange(n)
        for k in range(self.order, 0, -1):
            h = gram_hashes(codes, k)[self.order - k:][todo]
            at, known = self._find(self.grams, h)
            out[todo[known]] += self.logp[at[known]]
            todo = todo[~known]
            if not len(todo):
                return out
            if k > 1:
                at, seen = self._find(self.contexts, gram_hashes(codes[:-1], k - 1)[self.order - k:][todo])
                out[todo[seen]] += self.backoff[at[seen]]
        out[todo] += np.float32(self.floor)
        return out


def fit(counts: dict[str, Counter], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney models from each language's counts of n-grams of the highest order."""
    languages = sorted(counts)
    alphabet = {g[-1] for c in counts.values() for g in c}
    base = 1.0 / (len(alphabet) + 1)
    tables: dict[str, dict[str, float]] = {}
    weights: dict[str, dict[str, float]] = {}
    for lang in languages:
        by_order = {order: counts[lang]}
        for k in range(order - 1, 0, -1):      # a lower order counts the different characters before an n-gram
            by_order[k] = Counter(g[1:] for g in by_order[k + 1])
        prob: dict[str, float] = {}
        weight: dict[str, float] = {}
        for k in range(1, order + 1):
            c = by_order[k]
            ones, twos = sum(1 for v in c.values() if v == 1), sum(1 for v in c.values() if v == 2)
            discount = min(0.95, ones / (ones + 2 * twos)) if ones and twos else 0.5
            sums: dict[str, int] = defaultdict(int)
            kinds: dict[str, int] = defaultdict(int)
            for g, v in c.items():
                sums[g[:-1]] += v
                kinds[g[:-1]] += 1
            for h, total in sums.items():
                weight[h] = discount * kinds[h] / total
            for g, v in c.items():
                lower = prob[g[1:]] if k > 1 else base
                prob[g] = (v - discount) / sums[g[:-1]] + weight[g[:-1]] * lower
        tables[lang], weights[lang] = prob, weight

    def logp(lang: str, g: str) -> float:
        """Log probability of any n-gram, known to the language or not."""
        p, w, out = tables[lang], weights[lang], 0.0
        while g and g not in p:
            out += np.log(w[g[:-1]]) if g[:-1] in w else 0.0
            g = g[1:]
        return out + np.log(p[g] if g else base)

    def table(keys: set[str], value) -> tuple[np.ndarray, np.ndarray]:
        by_hash = {int(gram_hashes(codes_of(g), len(g))[-1]): g for g in keys}
        order_ = sorted(by_hash)
        rows = np.array([[value(lang, by_hash[h]) for lang in languages] for h in order_], np.float32).reshape(-1, len(languages))
        return np.array(order_, np.uint64), rows

    grams, probs = table({g for t in tables.values() for g in t}, logp)
    contexts, backoff = table({h for w in weights.values() for h in w if h}, lambda lang, h: np.log(weights[lang][h]) if h in weights[lang] else 0.0)
    # the empty context's weight is part of a character never seen, alike for all languages
    return Model(languages, order, grams, probs, contexts, backoff, float(np.log(base)), {})


def count_grams(labelled: DataFrame, order: int = ORDER) -> dict[str, Counter]:
    """Counts of n-grams by language of (lang, text) rows; counted on executors, the bounded sums come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch, values in texts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), values):
                s = START * (order - 1) + plain(text)
                found[lang].update(s[i:i + order] for i in range(len(s) - order + 1))
        rows = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    summed = labelled.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    out: dict[str, Counter] = defaultdict(Counter)
    for lang, gram, n in summed.collect():
        out[lang][gram] = n
    return dict(out)


def sample(labelled: DataFrame, docs: int, salt: str) -> DataFrame:
    """The ``docs`` different texts of each language (all of a rarer one) with the smallest salted hash, each once, however often it is
    repeated; only hashes are shuffled to find them."""
    hashed = labelled.select("lang", "text", F.xxhash64(F.lit(salt), "text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = {r[0]: r[1] for r in hashed.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= docs).groupBy("lang").agg(F.max("h")).collect()}
    if not last:
        return labelled.limit(0)
    limit = F.create_map(*(F.lit(x) for pair in last.items() for x in pair))[F.col("lang")]
    return hashed.where(F.col("h") <= limit).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def train(labelled: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Model | None:
    """Models of the languages of (lang, text) rows, with rejection limits; None without any row.

    Half of the texts, by hash, may be counted, the other half may calibrate. A language with texts in one half only uses them for both.
    """
    usable = labelled.where("lang is not null and text is not null").select("lang", "text")
    half = F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2))
    halves: dict[str, set[int]] = defaultdict(set)
    for lang, h in usable.select("lang", half).distinct().collect():
        halves[lang].add(h)
    alone = F.col("lang").isin([lang for lang, found in halves.items() if len(found) == 1])
    counts = count_grams(sample(usable.where((half == 0) | alone), train_docs, "train"), order)
    rest = usable.where((half == 1) | alone)
    if not counts:
        return None
    model = fit(counts, order)
    for lang in model.languages:
        model.limits[lang] = [float("inf")] * len(LENGTHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            total, n = model.score([plain(t) for t in values])
            ce = -total / np.maximum(n, 1)[:, None]
            best = ce.argmin(axis=1)
            size = np.searchsorted(LENGTHS, n, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array([model.languages[b] for b in best]), pa.array(size.astype("int64")),
                                              pa.array(ce.min(axis=1, initial=np.inf))], ["lang", "size", "ce"])

    highest = sample(rest, calibration_docs, "calibrate").mapInArrow(run, "lang string, size long, ce double").groupBy("lang", "size").agg(F.max("ce"))
    for lang, size, ce in highest.collect():
        model.limits[lang][size] = ce + MARGIN
    for limits in model.limits.values():     # a length without calibration texts takes the limit of the next shorter or longer one
        for order_ in (range(len(limits)), reversed(range(len(limits)))):
            last = float("inf")
            for i in order_:
                last = limits[i] = limits[i] if limits[i] < float("inf") else last
        for i in reversed(range(len(limits) - 1)):      # a short text is surprising more easily, never less
            limits[i] = max(limits[i], limits[i + 1])
    return model


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, lang_pred, score (0 to 1), cross_entropy and rejected, of every row."""
    data = docs.select(*keep, F.col(text_col).cast("string").alias("text__"))
    shared = docs.sparkSession.sparkContext.broadcast(model)   # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, values in texts(batches, "text__"):
            lang, score, ces, rejected = [], [], [], []
            lowered = [plain(t) for t in values]
            total, n = m.score(lowered) if m else (None, None)
            for i, t in enumerate(lowered):
                if m is None or not any(map(str.isalpha, t)):
                    lang.append("und"), score.append(0.0), ces.append(None), rejected.append(True)
                    continue
                row, best = total[i], int(total[i].argmax())
                ce = float(-row[best] / n[i])
                lang.append(m.languages[best])
                # the likelihoods' shares, tempered by the length: neighbouring characters say the same thing
                score.append(float(1 / np.exp(np.maximum((row - row[best]) / np.sqrt(n[i]), -700)).sum()))
                ces.append(ce)
                rejected.append(ce > m.limits[m.languages[best]][int(np.searchsorted(LENGTHS, n[i], side="right")) - 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(ces, pa.float64()), pa.array(rejected, pa.bool_())],
                                             [*keep, "lang_pred", "score", "cross_entropy", "rejected"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return data.mapInArrow(run, f"{kinds}, lang_pred string, score double, cross_entropy double, rejected boolean")
