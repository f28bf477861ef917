"""URL rules against plain matching; WARC archives by a round trip."""
import base64
import gzip
import hashlib
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from prosopo.llm import urlfilter, warc
from prosopo.llm.queries import URL_RULES
from prosopo.session import new_folder

R = random.Random(4)


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit)[2:] if fit else (None, "block" if host == "" else "allow")
    return host, path, rule, verdict


def urls():
    hosts = ["example.org", "a.EXAMPLE.org", "notexample.org", "b.com", "com", "x.y.net", "", "org", ".org", "a..com", "é.com"]
    paths = ["", "/", "/es/1", "/en/1", "/en/23", "/fr/", "/de/x/y", "/de", "?q=/de/", "#/fr/", "/es/?a#b", "/a\nb"]
    return [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths] + [None, "", "nothing", "://", "a://b://c/fr/", "//example.org/es/"]


def test_rules_against_plain_matching(table):
    rows = [(i, u, "x") for i, u in enumerate(urls())]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(table(rows, "page_id long, url string, key string"), URL_RULES).collect()}
    assert got == {i: judged(u, URL_RULES) for i, u, _ in rows}
    assert urlfilter.judge(table([], "page_id long, url string"), URL_RULES).count() == 0


@pytest.mark.parametrize("listed,universe", [(200, 3000), (1, 500), (500, 600)])
def test_cascade_is_exact_on_its_universe(spark, listed, universe):
    keys = [f"key{i}.org/" for i in range(universe)]
    known = set(R.sample(keys, listed)) | {"not-in-the-corpus/"}
    df = spark.createDataFrame([(k,) for k in keys] * 2, "key string")
    levels = urlfilter.cascade(spark.createDataFrame([(k,) for k in known], "key string"), df, "t")
    got = {r[0] for r in df.where(urlfilter.is_listed(levels, F.col("key"))).collect()}
    assert got == known & set(keys)
    assert urlfilter.cascade(spark.createDataFrame([], "key string"), df, "t") == []


def pages():
    same = "<p>same</p>"
    return [(1, "http://a/", same), (2, "http://b/", same), (9, "http://c/ ü\r\nX: y", same), (3, None, ""), (4, "http://d/", None), (5, "u", "é" * 1000),
            (6, "v", "Content-Length: 3\r\n\r\nx" * 50), (7, "w", "x"), (7, "w2", "x"), (8, "w3", "x"), (8, "w4", "x"), (None, "n", same)]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 40, "roll_bytes": 1}])
def test_round_trip(spark, table, options):
    df = table([(i, u, h, 1) for i, u, h in pages()], "page_id long, url string, html string, block long")
    got = sorted(warc.round_trip(spark, df, **options).collect(), key=str)
    want = []
    for i, _, h in pages():
        payload = (h or "").encode()
        last = max((j for j, _, g in pages() if (g or "") == (h or "") and j is not None), default=None)
        old = i is not None and i < last
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if old else "response", last if old else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_small_payloads_are_never_revisits(spark, table):
    df = table(pages(), "page_id long, url string, html string")
    assert {r.record_type for r in warc.round_trip(spark, df, revisit_bytes=10 ** 6).collect()} == {"response"}
    assert warc.round_trip(spark, table([], "page_id long, url string, html string")).count() == 0


def test_files_are_equal_whatever_the_partitions_and_commits_may_repeat(spark, table):
    sums = []
    for parts in (1, 4):
        folder = new_folder(spark, "warc-test")
        manifest = warc.write(table(pages(), "page_id long, url string, html string", parts), folder, shard_bytes=50)
        sums.append(sorted((r.name, r.sha256) for r in manifest.collect()))
        path = folder.removeprefix("file:")
        for r in manifest.collect():
            data = open(f"{path}/{r.name}", "rb").read()
            assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.bytes
            assert gzip.decompress(data).count(b"WARC/1.1\r\n") == r.records
    assert sums[0] == sums[1] and len(sums[0]) > 1


def test_damage_is_noticed(spark, table):
    folder = new_folder(spark, "warc-test")
    manifest = warc.write(table(pages(), "page_id long, url string, html string"), folder)
    name = manifest.first().name
    path = f"{folder.removeprefix('file:')}/{name}"
    data = gzip.decompress(open(path, "rb").read()).replace(b"<p>same", b"<p>sane")
    members = [b"WARC/1.1" + m for m in data.split(b"WARC/1.1")[1:]]
    open(path, "wb").write(b"".join(map(gzip.compress, members)))
    with pytest.raises(Exception, match="damaged"):
        warc.read(manifest, folder).collect()
    assert urllib.parse.urlparse(folder).path
