"""Near-duplicate vectors and exact top-k, against brute force."""
import numpy as np
import pytest

from prosopo.llm import neardup, topk

NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, [0.0] * 8), (902, [NAN] + [1.0] * 7), (903, [INF] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [])]


def clustered(n, dim, seed, noise=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    return [(i, [float(x) for x in centres[rng.integers(len(centres))] + noise * rng.normal(size=dim)]) for i in range(n)]


def brute(rows, threshold):
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    link = {i: {j for j in ids if j != i and good[i] @ good[j] >= threshold} for i in ids}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in link.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j), todo.append(j)
        out[i] = (len(link.get(i, ())), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("block", [1024, 5])
def test_links_components_and_copies(table, block):
    rows = clustered(150, 8, 1) + [(500 + k, [1.0] * 8) for k in range(12)] + [(600, [2.0] * 8)] + ODD
    df = table([(i, v, "x", i) for i, v in rows], "vec_id long, embedding array<double>, label string, v long")
    got = {r[0]: tuple(r)[1:] for r in neardup.near_duplicates(df, block=block).collect()}
    want = brute(rows, 0.9)
    assert set(got) == set(want)
    linked = sum(w[0] for w in want.values())
    assert sum(g[0] for g in got.values()) >= 0.98 * linked and all(got[i][0] <= want[i][0] for i in want)
    assert all(got[i] == want[i] for i, _ in ODD)
    assert got[505] == want[505] and got[600][0] >= 12       # copies, and a multiple of them


def test_no_vectors(table):
    empty = table([], "vec_id long, embedding array<float>")
    assert neardup.near_duplicates(empty).count() == 0
    one = table([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neardup.near_duplicates(one).collect()] == [(1, 0, 1, True)]


def test_count_is_calibrated_for_the_threshold():
    plan = neardup.calibrate(5000, 16, 0.9, 0.005)
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2000, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = neardup.Rows(plan, plan.directions(), a), neardup.Rows(plan, plan.directions(), b)
    found = (x.cells == y.cells).any(axis=1) & ((np.abs(x.steps - y.steps) <= 65).sum(axis=1) >= plan.needed)
    assert found.mean() > 0.97


def top(rows, k):
    vs = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(vs):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vs[q], v)), i) for i, v in vs.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def run_top(df, k=5, **options):
    from pyspark.sql import functions as F
    v = topk.usable(df, "vec_id", "embedding").select("id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"))
    return sorted(tuple(r) for r in topk.search(v, v.where("id % 50 = 0"), k, **options).collect())


@pytest.mark.parametrize("bucket,query_block", [(4096, 512), (16, 2)])
def test_top_scores_and_ties(table, bucket, query_block):
    rng = np.random.default_rng(7)
    rows = clustered(240, 8, 2) + [(300 + k, [0.5] * 8) for k in range(9)] + [(400, [3.0] * 8), (450, [-1.0] * 8), (460, [1e9] * 8)] + ODD
    rows = [(i, v if v is None else [x if x is None else float(x) * (1 + 4 * (i % 5 == 0)) for x in v]) for i, v in rows]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = table([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, block long")
    assert run_top(df, bucket=bucket, query_block=query_block) == top(rows, 5)


def test_fewer_candidates_than_k_and_none(table):
    schema = "vec_id long, embedding array<float>"
    assert run_top(table([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [-1.0, 1.0])], schema)) == [(0, 1, 1, 3 * 65536), (0, 2, 2, 65536)]
    assert run_top(table([(0, [1.0])], schema)) == []
    assert run_top(table([], schema)) == []
