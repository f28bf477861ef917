"""Repeats, fingerprints, packing, BPE, languages and licences, against brute force or the library they must equal."""
import hashlib
import random
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosopo.llm import bpe, common, langid, licenses, packing, simhash, simhash_wide, suffixdedup
from prosopo.llm.queries import vocabulary
from prosopo.session import RELEASE, cut_lineage

R = random.Random(11)
WORDS = ["".join(R.choice("abcdeéß") for _ in range(R.randint(2, 7))) for _ in range(60)]
SCHEMA = "doc_id long, text string, source string"


def prose(n, rng=R):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(rows):
    return [(i, t, "s") for i, t in rows]


# -- repeats ------------------------------------------------------------------------------

def cut(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_rows():
    shared = [prose(50) for _ in range(5)]
    rows = [(i, "\n".join(R.choice(shared)[R.randint(0, 80):][:R.randint(40, 350)] if R.random() < .5 else prose(R.randint(1, 50)) for _ in range(4))) for i in range(70)]
    return rows + [(200, "be " * 200), (201, "ab" * 150), (202, "x" * 400), (203, None), (204, ""), (205, "be " * 90), (206, "x" * 100), (207, "x" * 99), (208, shared[0][:100])]


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats_are_cut(table, hot):
    rows = repeated_rows()
    got = sorted(tuple(r)[:5] for r in suffixdedup.remove_repeats(table(docs(rows), SCHEMA), hot=hot).collect())
    assert got == cut(rows)


def test_repeats_with_small_slices_and_buckets(spark, table, monkeypatch):
    rows = repeated_rows()
    texts = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    starts = np.arange(len(texts) - 100)
    windows = [texts[s:s + 100].tobytes() for s in starts]
    first = {}
    want = [not (first.setdefault(w, s) == s) for s, w in enumerate(windows)]
    assert suffixdedup.repeated(np.concatenate([texts, np.zeros(64, np.uint8)]), starts, (starts,), 100).tolist() == want
    assert [windows[i] for i in suffixdedup.suffix_order(suffixdedup.words_at(np.concatenate([texts, np.zeros(64, np.uint8)])), starts, 100)] == sorted(windows)


def test_cover_has_every_distance():
    d = suffixdedup.COVER
    assert {(a - b) % suffixdedup.PERIOD for a in d for b in d} == set(range(suffixdedup.PERIOD))


def test_repeats_with_shared_and_missing_ids(table):
    rows = [(None, prose(40)), (1, prose(40)), (1, prose(40))]
    same = rows[1][1]
    got = suffixdedup.remove_repeats(table(docs([*rows, (1, same)]), SCHEMA)).collect()
    assert len(got) == 4 and sum(r.n_removed for r in got) == len(same.encode())
    assert suffixdedup.remove_repeats(table([], SCHEMA)).count() == 0


class Taken:
    """Stands for a table whose rows go through a function of batches: keeps the function."""
    select = repartition = sortWithinPartitions = lambda self, *a: self

    def mapInArrow(self, run, schema):
        return run


def most_memory(run, batch):
    tracemalloc.start()
    try:
        made = sum(b.num_rows for b in run(iter([batch])))
        return made, tracemalloc.get_traced_memory()[1] / batch.nbytes
    finally:
        tracemalloc.stop()


def test_repeats_take_memory_by_slices_not_batches():
    rng, n = np.random.default_rng(3), 4000
    text = [bytes(x).decode() for x in rng.integers(97, 123, (n, 2500), dtype=np.uint8)]
    long = pa.table({"doc": np.arange(n), "tie": np.zeros(n, np.int64), "text": text}).combine_chunks().to_batches()[0]
    made, share = most_memory(suffixdedup.find_runs(Taken(), 100), long)
    assert made > n * 2400 / 69 and share < 6
    n = 40000
    contexts = {"kind": np.zeros(n, np.int8), "route": np.arange(n), "doc": np.arange(n), "tie": np.zeros(n, np.int64), "lo": np.zeros(n, np.int64), "n": np.full(n, 35, np.int32),
                "off": np.full(n, 20, np.int32), "bytes": [x[:134].encode() for x in (text * 10)]}
    _, share = most_memory(suffixdedup.sort_buckets(Taken(), 100), pa.table(contexts).combine_chunks().to_batches()[0])
    assert share < 8


def test_stripped_text_keeps_whole_characters(table):
    a = "é" * 80 + "tail"
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    df = table([(1, a, "fr", "s", 84), (2, "x" + a + "new", "fr", "s", 88), (3, a, "fr", "s", 84), (4, None, "fr", "s", 0)],
               "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffixdedup.strip_repeats(df, columns).collect()}
    # a's own run of equal characters repeats within it
    assert set(got) == {1, 2, 4} and got[4] == (None, 0) and got[2] == ("xnew", 4)


@pytest.mark.parametrize("shared_ids", [False, True])
def test_texts_are_dealt_out_once(spark, table, shared_ids):
    a, rng = prose(60), random.Random(5)
    df = table([(i // (1 + shared_ids), prose(40, rng) + a + prose(40, rng), "s", i) for i in range(40)], "doc_id long, text string, source string, n_chars long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (suffixdedup.strip_repeats(df, ("doc_id", "text", "source", "n_chars")), suffixdedup.remove_repeats(df)):
            plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
            assert sum("ReusedExchange [doc" in x and "text" in x for x in plan) == 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_written_steps_leave_no_shuffle_files(spark):
    def files():
        kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {x for x in kept if "/shuffle_" in x}
    before, setting = files(), spark.conf.get(RELEASE, None)
    step = cut_lineage(spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):     # files go a little later
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(RELEASE, None) == setting
    assert step.count() == 7


def test_components_take_no_round_for_stars(spark, monkeypatch):
    written = []
    monkeypatch.setattr(common, "cut_lineage", lambda df, name: written.append(name) or cut_lineage(df, name))
    stars = [(b, a) for a in (1, 2, 3) for b in range(10 * a, 10 * a + 9)]
    got = dict(common.components(spark.createDataFrame(stars, "a long, b long")).collect())
    assert got == {**{b: a for b, a in stars}, 1: 1, 2: 2, 3: 3} and len(written) == 1
    chain = [(i, i + 1) for i in range(50)] + [(60, 61), (61, 60), (62, 62)]
    got = dict(common.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, 60: 60, 61: 60}
    assert not common.components(spark.createDataFrame([], "a long, b long")).collect()


# -- fingerprints -------------------------------------------------------------------------

def plain_fingerprint(text, size=3):
    import xxhash
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    s = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps, near):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in ids:
        for j in ids:
            if j < i and near(fps[i], fps[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [256, 1])
def test_fingerprints_link_within_two_bits(table, bucket):
    rows = [(i, prose(R.randint(0, 30))) for i in range(40)]
    rows += [(100 + i, rows[i % 40][1] + (" x" if i % 3 else "")) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One"), (304, "one TWO"), (305, "A B C D"), (306, "a b c d"), (307, "\x1ca b\x85c d")]
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(table(docs(rows), SCHEMA), bucket=bucket).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: g[0] for i, g in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    want = closure(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert {i: g[1] for i, g in got.items()} == want


@pytest.mark.parametrize("radius,segments,bucket", [(2, 2, 256), (2, 2, 2), (3, 3, 256), (4, 3, 3)])
def test_index_finds_every_link(spark, radius, segments, bucket):
    rng = random.Random(radius * 10 + segments)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(25)})
    signed = {v - (1 << 64) if v >= 1 << 63 else v: v for v in values}
    df = spark.createDataFrame([(k, k) for k in signed], "fp long, doc_id long")
    got = {r[0]: r[1] for r in simhash.component_ids(df, "doc_id", radius, segments, bucket).collect()}
    by_root = defaultdict(set)
    for fp, root in closure({k: v for k, v in signed.items()}, lambda a, b: bin(a ^ b).count("1") <= radius).items():
        by_root[root].add(fp)
    assert got == {fp: min(members) for members in by_root.values() for fp in members}


def test_empty_table_has_no_fingerprints(table):
    assert simhash.near_duplicates(table([], SCHEMA)).count() == 0
    assert simhash_wide.component_ids(table([], SCHEMA)).count() == 0


def test_wide_fingerprints_find_similar_texts(table):
    rng = random.Random(5)
    vocabulary_ = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [[rng.choice(vocabulary_) for _ in range(250)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        rows.append((k, " ".join(words)))
        for c in range(1, 6):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(len(w))] = rng.choice(vocabulary_)
            rows.append((k + 100 * c, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "short text"), (903, "short text"), (904, "another")]
    sets = {i: frozenset(tuple((t or "").split()[j:j + 5]) for j in range(max(1, len((t or "").split()) - 4))) for i, t in rows}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    got = {r[0]: r[1] for r in simhash_wide.component_ids(table(docs(rows), SCHEMA)).collect()}
    need = closure(sets, lambda a, b: jaccard(a, b) >= 0.85)
    assert sum(got[i] == got[j] for i, j in need.items()) >= len(need) - 1
    for i in got:       # never a text of another base
        assert got[i] == i or jaccard(sets[i], sets[got[i]]) > 0.5
    assert got[901] == 900 and got[903] == 902 and got[904] == 904


def spliced(rng, n, same):
    """Two texts of ``n`` different words that share their first ``same``."""
    words = [f"w{rng.randrange(10 ** 9)}" for _ in range(2 * n)]
    return " ".join(words[:n]), " ".join(words[:same] + words[n:2 * n - same])


def test_wide_links_are_those_of_the_shingle_sets(table):
    rng = random.Random(8)
    rows, k = [], 0
    for same in (*[181] * 60, *[172] * 60):      # similarity 0.82, and 0.75
        for t in spliced(rng, 200, same):
            rows.append((k, t))
            k += 1
    line = "one long line that stands here again and again as a footer " * 40      # few shingles, each often
    rows += [(k, line + spliced(rng, 30, 0)[0]), (k + 1, line + spliced(rng, 30, 0)[0])]
    sets = {i: frozenset(tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)) for i, t in rows}
    got = {r[0]: r[1] for r in simhash_wide.component_ids(table(docs(rows), SCHEMA)).collect()}
    want = closure(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    wrong = [i for i in got if got[i] != i and want[i] == i]
    assert not wrong                                                # nothing goes without a true link
    assert sum(got[i] == want[i] for i in range(120)) >= 119        # and the true ones are found


def family(rng, n, twins):
    """``n`` texts of one template, alike by some 0.67, of which the first ``twins`` have a twin alike by 0.82 or more."""
    word = lambda: f"w{rng.randrange(10 ** 9)}"

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(5, len(words) - 5), n):
            out[at] = word()
        return out
    base, rows = [word() for _ in range(400)], []
    for k in range(n):
        w = edited(base, 8)
        rows.append((2 * k, " ".join(w)))
        if k < twins:
            rows.append((2 * k + 1, " ".join(edited(w, 8))))
    return rows


def shingle_sets(rows, size=5):
    return {i: frozenset(tuple(t.split()[j:j + size]) for j in range(len(t.split()) - size + 1)) for i, t in rows}


@pytest.mark.parametrize("block", [1000, 40])
def test_wide_links_survive_a_family_of_likenesses(table, monkeypatch, block):
    monkeypatch.setattr(simhash_wide, "BLOCK", block)
    rows = family(random.Random(9), 150, 150)
    sets = shingle_sets(rows)
    want = closure(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = {r[0]: r[1] for r in simhash_wide.component_ids(table(docs(rows), SCHEMA)).collect()}
    assert len({want[i] for i in want}) > 100
    assert all(want[i] == want[j] for i, j in got.items())
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_wide_rows_keep_every_column(table):
    rng = random.Random(10)
    x, y = spliced(rng, 200, 190)
    long_ = " ".join(f"v{rng.randrange(10 ** 9)}" for _ in range(60_000))
    rows = [(5, x, 77, "a", 1, "p", 9), (3, y, 99, "b", 2, "q", 8), (7, long_, 1, "c", 3, "r", 7), (8, long_ + " end", 1, "d", 4, "s", 6), (None, x, 2, "e", 5, "t", 5)]
    got = simhash_wide.first_rows(table(rows, "doc_id long, body string, row long, text string, id int, cls string, n int"), text_col="body")
    assert got.columns == ["doc_id", "body", "row", "text", "id", "cls", "n"]
    assert sorted(tuple(r) for r in got.collect()) == [rows[1], rows[2]]


def test_wide_index_grows_with_the_texts_alone(table, monkeypatch):
    """Unrelated texts share no entry, however many there are; a text has the same rows in every corpus."""
    from prosopo.llm import common
    written, plans = {}, []

    def keep(df, name="step", **options):
        if name == "simhash-edges":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = cut_lineage(df, name, **options)
        written.setdefault(name, []).append(out)
        return out
    monkeypatch.setattr(simhash_wide, "cut_lineage", keep)
    monkeypatch.setattr(common, "cut_lineage", keep)
    rng = random.Random(12)
    rows = [(k, spliced(rng, 30, 0)[0]) for k in range(1500)]
    x, y = spliced(rng, 200, 192)
    got = {r[0]: r[1] for r in simhash_wide.component_ids(table(docs([*rows, (9000, x), (9001, y)]), SCHEMA)).collect()}
    assert got == {**{k: k for k, _ in rows}, 9000: 9000, 9001: 9000}
    assert written["simhash-index"][0].count() == 0
    assert 0 < written["simhash-entries"][0].count() <= simhash_wide.tables(0.8, simhash_wide.MISS)
    assert written["simhash-texts"][0].count() == 2         # texts that no entry names are not sent
    assert plans and not any("Generate" in p for p in plans)


@pytest.mark.parametrize("words", [1, 2, 3])
def test_wide_links_leave_no_pair_out(table, words):
    """Every pair at the threshold is found: short texts, whose SimHashes may differ in many bits, and those that share no min-hash key."""
    rng = random.Random(14)
    rows, k = [], 0
    for n, more, pairs in ((8, 1, 2500), (12, 2, 600), (44, 10, 600)):     # similarity 0.8 each
        for _ in range(pairs):
            w = [f"w{rng.randrange(10 ** 9)}" for _ in range(n + more)]
            rows += [(k, " ".join(w[:n])), (k + 1, " ".join(w))]
            k += 2
    got = {r[0]: r[1] for r in simhash_wide.component_ids(table(docs(rows), SCHEMA), words=words).collect()}
    assert got == {i: i - i % 2 for i in range(k)}


def test_wide_bounds_hold_for_every_similar_pair():
    rng = np.random.default_rng(4)
    near, far = [], 0
    for n in (4, 5, 9, 40, 300, 1020, 1030, 5000):
        for _ in range(20):
            base = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
            new = rng.integers(0, 2 ** 64, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)
            lost = rng.permutation(base)[:rng.integers(0, n // 9 + 1)]
            near.append((base, np.unique(np.concatenate([np.setdiff1d(base, lost), new]))))
    common = np.unique(np.concatenate([rng.permutation(x)[:len(x) // 3] for x, _ in near]))
    both = [s for pair in near for s in pair]
    test = simhash_wide.near_parities(0.8)(pa.table({"run": [0] * len(both), "id": range(len(both)), "label": range(len(both)), "size": [len(x) for x in both],
                                                     "odd": [simhash_wide.parities(x) for x in both]}))
    at = np.arange(0, len(both), 2)
    passed = test(at, at + 1)
    for (x, y), ok in zip(near, passed):
        if simhash_wide.jaccard(x, y) >= 0.8:
            assert ok and len(np.intersect1d(*(simhash_wide.first_shingles(s, 0.8, common) for s in (x, y))))
            far += 1
    assert far > 80
    other = np.arange(0, len(both) - 40, 2)
    assert not test(other, other + 40)[8:].any()        # sets of other shingles


def test_shared_shingles_are_counted():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 300), dtype=np.uint64)) for _ in range(60)]
    counts = simhash_wide.shared(sets)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(i + 1, 60))


# -- packing ------------------------------------------------------------------------------

def test_pieces_cover_every_document_once(table):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [(i, prose(R.choice([0, 1, 5, 40, 300, 2500]))) for i in range(60)] + [(100, None), (101, ""), (102, "<|endoftext|> a"), (103, "  \n x" * 50), (7, "again"), (104, "数据 ½ don't")]
    got = packing.pack_documents(table(docs(rows), SCHEMA), vocabulary("byte_bpe_50k.tiktoken"), special={"<|endoftext|>": 50256}, pool_ids=5000).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        parts[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
    for i, pieces in parts.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert set(parts) == set(ids) and padding <= 2048 * 3       # one window a partition


def test_step_groups_are_even():
    sizes = [2048] * 50 + [256] * 300
    groups = packing.step_groups(sizes, 20_000)
    load = defaultdict(int)
    for s, g in zip(sizes, groups):
        load[g] += s
    assert max(load.values()) - min(load.values()) <= 2048
    assert packing.step_groups([], 10) == []


# -- BPE ----------------------------------------------------------------------------------

def encoded(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_digests_equal_the_library(table):
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = [None, "", " \n", "It's We'RE", "İstanbul ΣΑΣ", "a\x1cb\x85c", "\xa0x\xa0", "½²Ⅷ", "数据 text", "<|endoftext|> x<|startoftext|>", "ab\u0301 \u0301c", "''s'''re",
           "x" * 700, "ab1!" * 300, "é" * 500, "<|endoftext|>" + "q" * 300 + " tail", prose(3000)]
    rows = list(enumerate(odd)) + [(100 + i, "".join(R.choice("ab'sreé\x85 \n½Å\u030a1.!<|") for _ in range(80))) for i in range(40)] + [(3, "It's We'RE")]
    got = sorted(tuple(r) for r in bpe.encode_digests(table(docs(rows), SCHEMA), path, long_run=64, leaf=7).collect())
    assert got == sorted((i, *encoded(tok, t)) for i, t in rows)
    assert bpe.encode_digests(table([], SCHEMA), path).count() == 0


def test_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 8)
    model = bpe.WordBpe(vocabulary("word_bpe_49k.json"))
    for _ in range(30):
        text = prose(R.randint(1, 40))
        assert model.encode(text) == model.plain(text)


def test_words_are_found_at_once(monkeypatch):
    """The words of all chunks are found in one pass, not chunk by chunk."""
    found, calls = bpe._WORDS, []

    class Words:
        def findall(self, text):
            calls.append(text)
            return found.findall(text)

    monkeypatch.setattr(bpe, "_WORDS", Words())
    model, text = bpe.WordBpe(vocabulary("word_bpe_49k.json")), prose(500)
    assert model.encode(text) == model.plain(text) and len(calls) == 1


@pytest.mark.parametrize("size", [1, 50, 400, 1 << 20])
def test_texts_of_a_slice_stay_apart(monkeypatch, size):
    monkeypatch.setattr(bpe, "SLICE", size)
    model, rng = bpe.WordBpe(vocabulary("word_bpe_49k.json")), random.Random(5)
    ends = ["", "\n", " İĳ J\u030c", " \x85\xa0", " 数据 Ⅷ", "!?" * 5, "<|endoftext|>"]
    texts = [prose(rng.randint(0, 30), rng) + rng.choice(ends) for _ in range(120)] + ["", " "]
    parts = list(bpe.slices(pa.array(["left out", *texts], pa.large_string())[1:]))
    assert [t for p in parts for t in p.to_pylist()] == texts
    assert all(len(p) == 1 or sum(len(t.encode()) for t in p.to_pylist()) <= size for p in parts)
    assert [m for p in parts for m in zip(*(x.tolist() for x in model.encode_texts(p)))] == [model.plain(t) for t in texts]


# -- languages ----------------------------------------------------------------------------

SYLLABLES = {"aa": ["ka", "tok", "mi", "ren"], "bb": ["schu", "eit", "ung", "ber"], "cc": ["ção", "lhe", "nho", "ques"]}


def say(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_on_texts_held_out(table):
    rng = random.Random(2)
    rows = [(lang, say(lang, rng.randint(1, 60), rng)) for lang in SYLLABLES for _ in range(120)] + [(None, "x"), ("aa", None)]
    model = langid.train(table(rows, "lang string, text string"))
    test = [(i, say(lang, rng.randint(2, 40), rng), lang) for i, lang in enumerate(list(SYLLABLES) * 30)]
    odd = [(900, None, None), (901, "", None), (902, "12 !?", None), (903, "²", None), (904, "Ka tok MI " * 60000, "aa"), (905, "zzqx wvfj kkpw " * 30, None)]
    got = {r.doc_id: r for r in langid.identify(table(test + odd, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 0.97 * len(test)
    assert sum(not got[i].rejected for i, *_ in test) >= 0.98 * len(test)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902, 903))
    assert got[904].lang_pred == "aa" and got[905].rejected and all(0 <= r.score <= 1 for r in got.values())


def test_copies_do_not_crowd_out_a_language(table):
    rng = random.Random(4)
    rows = []
    for k in range(4):      # one text holds most rows of the language
        rows += [(f"hot{k}", say("aa", 20, rng))] * 2000 + [(f"hot{k}", say("bb", 20, rng)) for _ in range(60)]
    got = langid.sample(table(rows, "lang string, text string"), 20, "train").collect()
    assert len(got) == len(set(got)) == 80 and all(sum(r.lang == f"hot{k}" for r in got) == 20 for k in range(4))
    rows += [(f"one{k}", say("cc", 30, rng)) for k in range(8)]      # languages of a single text
    model = langid.train(table(rows, "lang string, text string"), train_docs=20, calibration_docs=20)
    assert model.languages == sorted({lang for lang, _ in rows})
    assert all(max(limits) < float("inf") for lang, limits in model.limits.items() if lang.startswith("one"))


def test_probabilities_sum_to_one():
    from collections import Counter
    text = langid.START * 3 + "abracadabra abra"
    model = langid.fit({"x": Counter(text[i:i + 4] for i in range(len(text) - 3))})
    letters = sorted(set(text) - {langid.START})
    for context in ("abr", "zzz", "cad", "aab"):
        total = sum(np.exp(float(model._logp(langid.codes_of(context + c))[0, 0])) for c in letters)
        assert 0.5 < total <= 1.0001


def test_no_training_rows(table):
    assert langid.train(table([], "lang string, text string")) is None
    got = langid.identify(table([(1, "abc", "s")], SCHEMA), None).collect()
    assert [(r.lang_pred, r.rejected) for r in got] == [("und", True)]


# -- licences -----------------------------------------------------------------------------

def test_licences(table):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy"
    rows = [(1, "Released under the MIT License."), (2, "under the mit licence"), (3, "Apache License, Version 2.0 and apache license version 2"), (4, None), (5, ""),
            (6, "x " * 5000 + "CC BY-NC 4.0"), (7, mit), (8, "under the mit under the mit license"), (9, "é under-the_MIT/license é"), (10, "version 2 apache license"),
            (11, "GNU General Public License, version 3")]
    got = {r.doc_id: r for r in licenses.scan(table(docs(rows), SCHEMA)).collect()}
    flat = {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for i, r in got.items()}
    assert flat[1] == (5, 1, 1, 1, "mit", "mit") and flat[2] == (4, 0, None, None, "", "")
    assert flat[3] == (10, 2, 0, 6, "apache-2", "apache-2") and flat[4] == flat[5] == (0, 0, None, None, "", "")
    assert flat[6][1:4] == (1, 5000, 5000) and flat[7][4:] == ("", "mit") and flat[8][1:4] == (1, 3, 3)
    assert flat[9] == (6, 1, 1, 1, "mit", "mit") and flat[10][1] == 0 and flat[11][4:] == ("", "gpl-3")
    assert got[1].score == 1.0 and got[2].score == 0.0 and 0.5 < got[7].score < 1
    assert licenses.scan(table([], SCHEMA)).count() == 0
