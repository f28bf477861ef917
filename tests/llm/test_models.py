"""Class-based scoring, importance resampling and centroid clustering against plain Python."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosopo.llm import brown, centroids, resample

# ---- centroid clustering


def plain_clusters(rows, dim, k, rounds, scale, seed):
    kept = [(i, tuple(math.floor(float(x) * scale) for x in v)) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [tuple(sum(col) // len(groups[j]) for col in zip(*groups[j])) if groups[j] else c[j] for j in range(len(c))]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), c


def clustered(df, dim, k, rounds, scale, seed, **more):
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    placed, c = centroids.cluster(centroids.whole_vectors(df, "vec_id", "embedding", dim, scale), dim, k, rounds, order, **more)
    return placed, [tuple(x) for x in c.tolist()]


@pytest.mark.parametrize("k,rounds,span", [(1, 2, 40), (5, 6, 3), (12, 8, 200)])
def test_clusters_against_plain(table, k, rounds, span):
    rng = random.Random(k)
    rows = [(i, [rng.randint(-span, span) / 8 for _ in range(3)]) for i in range(300)]
    rows += [(7, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5]), (None, [1.0, 1.0, 1.0]), (900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 2.0]),
             (903, [float("inf"), 0.0, 0.0]), (904, [1.0]), (905, [])]
    placed, c = clustered(table(rows, "vec_id long, embedding array<double>", 5), 3, k, rounds, 8, "3", block=16)
    want, want_c = plain_clusters(rows, 3, k, rounds, 8, "3")
    assert sorted(map(tuple, placed.collect()), key=str) == want and c == want_c


def test_few_vectors_none_and_clashing_names(table):
    rows = [(1, [0.5, 1.0], "a", 1, 2), (2, [0.5, 1.0], "b", 3, 4)]
    df = table(rows, "vec_id long, embedding array<float>, id string, block int, near int")
    placed, c = clustered(df, 2, 8, 3, 2, "3")
    assert sorted(map(tuple, placed.collect())) == [(1, 0, 0), (2, 0, 0)] and len(c) == 2     # ties go to the smaller number
    empty, none = clustered(df.where("false"), 2, 8, 3, 2, "3")
    assert empty.collect() == [] and none == [] and centroids.with_inertia(empty, np.zeros((0, 2))).columns[-1] == "centroid_sha256"
    with pytest.raises(Exception, match="larger than"):
        clustered(table([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 2, 2, 1, 1, "3")


def test_inertia(table):
    placed, c = clustered(table([(i, [float(i % 5), float(i // 7)]) for i in range(40)], "vec_id long, embedding array<double>"), 2, 3, 4, 1, "3")
    rows = centroids.with_inertia(placed, np.array(c)).collect()
    total = sum(r.distance for r in rows)
    for r in rows:
        assert r.inertia == total and r.cluster_inertia == sum(q.distance for q in rows if q.cluster == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_search_measures_few_distances():
    """Grouped vectors after small moves: most are done by their bounds, and the search equals a full one."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-1000, 1000, (40, 8))
    x = (middle[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(np.int64)
    c = middle + rng.integers(-30, 30, middle.shape)
    near, second, d1, d2 = centroids.first_search(x, c)
    upper, lower, spent = np.sqrt(d1), np.sqrt(d2), 0
    for _ in range(4):
        after = c + rng.integers(-8, 9, c.shape)
        now = centroids.Round(after, np.sqrt(((after - c) ** 2).sum(axis=1).astype(float)))
        near, second, upper, lower, measured = centroids.shallot(x, near, second, upper, lower, now)
        spent, c = spent + measured, after
        full = centroids.first_search(x, c)
        assert (near == full[0]).all() and (lower <= np.sqrt(full[3]) + 1e-6).all() and (upper >= np.sqrt(full[2]) - 1e-6).all()
    assert spent < 0.1 * 4 * x.shape[0] * len(c)


# ---- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_draw(docs, target, percent, least, longest, buckets, seed):
    def found(text):
        w = WORD.findall((text or "").translate(AZ))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    cut = [(i, *found(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in cut for b in f), Counter(b for _, x in target for b in found(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    out = []
    for i, n, f in cut:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for r in out:
        r.append(None)
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(((*r[:4], r[5]) for r in out), key=str)


def sample_texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ab", "ß", "x9", "日本", "é", "q") for b in ("", "cd", "E")]
    line = lambda: rng.choice([" ", "-", "\t", " "]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 12])))
    common = [line() for _ in range(4)]
    return ["\n".join(rng.choice(common) if rng.random() < 0.4 else line() for _ in range(rng.choice([1, 1, 2, 5]))) for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_draw_against_plain(table, longest):
    docs = list(enumerate(sample_texts(150)))
    docs += [(200, None), (201, ""), (202, "\n\n !\n"), (203, "one"), (204, "same line\nsame line\nsame line"), (205, "\na\n\nb\n" * 3 + "long" * 100 + " " * 500 + "w\n" + "x y " * 5000)]
    target = [(1, "abcd x9 ß"), (2, None), (3, "日本 é\nq x9E")]
    got = resample.resample(table([(*d, "t", 1) for d in docs], "doc_id long, text string, row string, line int"), table(target, "item_id long, text string"), 25, 5, longest, 97, "7")
    assert sorted(map(tuple, got.collect()), key=str) == plain_draw(docs, target, 25, 5, longest, 97, "7")


def test_draw_of_repeated_and_null_ids_and_empty_tables(table):
    docs = [(5, "a b c"), (5, "a b c"), (5, "d e f g"), (None, "a b c"), (None, None)]
    frame, none = table(docs, "doc_id long, text string"), table([], "item_id long, text string")
    assert sorted(map(tuple, resample.resample(frame, none, 100, 1).collect()), key=str) == plain_draw(docs, [], 100, 1, 2, 10_000, "7")
    assert resample.resample(frame.where("false"), none, 25, 20).collect() == []


# ---- class-based scoring


def plain_model(docs, held, k, core, rounds, mu):
    """Every step of the model with dictionaries, moves decided by whole likelihoods."""
    cut = [(i, h, [*(w.decode() for w in (t or "").encode().lower().split()), "\n"]) for (i, t), h in zip(docs, held)]
    learn = [w for _, h, w in cut if not h]
    c = Counter(x for w in learn for x in w)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for w in learn for p in zip(["\n", *w], w))
    top = sorted(c, key=lambda w: (-c[w], w))[:core]
    cls = {w: k - 1 for w in c} | {w: min(i, k - 1) for i, w in enumerate(top)}

    def grid_of(classes):
        out = Counter()
        for (a, b), m in pairs.items():
            out[classes[a], classes[b]] += m
        return out

    def value(grid):
        one, two = Counter(), Counter()
        for (a, b), m in grid.items():
            one[a] += m
            two[b] += m
        f = lambda xs: sum(x * math.log(x) for x in xs if x)
        return f(grid.values()) - f(one.values()) - f(two.values())

    def moved(word, classes):
        base = classes[word]
        scores = [value(grid_of(classes | {word: b})) for b in range(k)]
        best = max(range(k), key=lambda b: (round(scores[b] - scores[base], 6), -b))
        return best if round(scores[best] - scores[base], 6) > 0 else base

    best = (-math.inf, cls)
    for number in range(rounds + 1):
        now = value(grid_of(cls))
        if now <= best[0] + 1e-6:
            break
        best = (now, cls)
        if number == rounds or not top[number % 2::2]:
            break
        cls = cls | {w: moved(w, cls) for w in top[number % 2::2]}
        if cls == best[1] and number:
            break
    cls = best[1]
    cls = cls | {w: moved(w, cls) for w in c if w not in set(top)}
    grid = grid_of(cls)
    left, right = Counter(), Counter()
    for (a, b), m in grid.items():
        left[a] += m
        right[b] += m
    u = min(0.5, (sum(m == 1 for m in c.values()) + 1) / (n + 2)) if n else 1.0

    def p(before, word):
        if word not in c:
            return u
        share = right[cls[word]] / n
        move = share if before not in c else (grid[cls[before], cls[word]] + mu * share) / (left[cls[before]] + mu)
        return (1 - u) * move * c[word] / right[cls[word]]

    rows = [(i, h, len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w),
             sum(math.log10(p(a, b)) for a, b in zip(["\n", *w], w))) for i, h, w in cut]
    return rows, p, c


def spark_scores(table, docs, held, **more):
    df = table([(*d, "x", 1) for d in docs], "doc_id long, text string, words string, block int")
    numbers = [i for (i, _), h in zip(docs, held) if h]
    return sorted(map(tuple, brown.score_texts(df, F.col("id").isin(numbers), **more).collect()), key=str)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=str)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_scores_against_plain(table, block):
    rng = random.Random(5)
    words = ["the", "a", "cat", "Dog", "runs", "sleeps", "ßx", "日本", "on", "mat."]
    docs = [(i, " ".join(rng.choice(words[i % 3::2]) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, " \n\t"), (53, "new words only here"), (54, "the the the the"), (55, "new cat new cat")]
    held = [i % 7 == 2 for i, _ in docs]
    want, p, c = plain_model(docs, held, 4, 6, 5, 4.0)
    close(spark_scores(table, docs, held, classes=4, core=6, rounds=5, block=block, mu=4.0), want)
    for before in ("the", "\n", "never seen"):
        assert sum(p(before, w) for w in [*c, "never seen"]) == pytest.approx(1)


def test_scores_without_training_or_rows(table):
    docs = [(1, "a b"), (2, None)]
    got = spark_scores(table, docs, [True, True])
    assert [r[:5] for r in got] == [(1, True, 3, 0, 0), (2, True, 1, 0, 0)] and all(r[5] == r[6] == 0 for r in got)
    assert brown.score_texts(table([], "doc_id long, text string"), F.lit(False)).collect() == []
    twice = table([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    rows = sorted((tuple(r)[:5] for r in brown.score_texts(twice, F.col("id") == 3).collect()), key=str)
    assert rows == [(1, False, 3, 3, 10)] * 2 + [(None, False, 1, 1, 10), (None, False, 3, 3, 10)]


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(2)
    words, k = 30, 5
    pairs = rng.poisson(0.6, (words, words))
    cls = rng.integers(0, k, words)
    member = np.eye(k, dtype=np.int64)[cls]
    grid = member.T @ pairs @ member
    got = brown.gains(pairs @ member, pairs.T @ member, np.diag(pairs), cls, grid)
    for w in range(words):
        values = []
        for b in range(k):
            other = cls.copy()
            other[w] = b
            m = np.eye(k, dtype=np.int64)[other]
            values.append(brown.likelihood((m.T @ pairs @ m).astype(float)))
        assert np.allclose(got[w] - got[w, cls[w]], np.array(values) - values[cls[w]])


def test_classes_find_the_kinds_of_words(table):
    """Two kinds of words that take turns end in classes of their own, and held-out text is less surprising than by words alone."""
    rng = random.Random(9)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    docs = [(i, " ".join(x for _ in range(30) for x in (rng.choice(nouns), rng.choice(verbs)))) for i in range(80)]
    held = [i % 7 == 2 for i, _ in docs]
    got = spark_scores(table, docs, held, classes=4, core=40)
    assert all(r[6] > r[5] + 10 for r in got)
