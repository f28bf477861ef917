import datetime as dt
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F, types as T

from prosopo.sources import dictionary as dc, dump, jdbc, lists, tables
from prosopo.sources.types import spark_type
from tests.conftest import rows

CREATE = "CREATE TABLE `t` (\n  `id` int(11) NOT NULL,\n  `name` varchar(50) DEFAULT NULL,\n  `score` double DEFAULT NULL,\n  PRIMARY KEY (`id`,`name`)\n);\n"


@pytest.fixture()
def read(spark, tmp_path):
    def go(text, **more):
        data = text if isinstance(text, bytes) else text.encode()
        (tmp_path / "d.sql").write_bytes(data)
        return dump.read_dump(spark, str(tmp_path / "d.sql"), **more)
    return go


def test_rows_and_types(read):
    got = read(CREATE + "INSERT INTO `t` VALUES (40,'river',NULL),(-7,'',2.5e-3),\n(41,'ελιά',6.0E+2);\n").tables["t"]
    assert got.dtypes == [("id", "int"), ("name", "string"), ("score", "double")]
    assert rows(got) == [(-7, "", 2.5e-3), (40, "river", None), (41, "ελιά", 600.0)]


@pytest.mark.parametrize("written,meant", [
    (r"it\'s", "it's"), (r"a\nb\rc\td", "a\nb\rc\td"), (r"\0end\Z\b", "\x00end\x1a\x08"), (r"c:\\new\\table", r"c:\new\table"),
    (r"\\\\n", r"\\n"), (r"\w\%\_", "w%_"), (r"\\\'", r"\'"), ('say \\"so\\"', 'say "so"')])
def test_escapes(read, written, meant):
    assert read(CREATE + f"INSERT INTO `t` VALUES (9,'{written}',0);\n").tables["t"].first()["name"] == meant


def test_long_texts_with_many_escapes(read):
    text = "\\n\\'" * 200_000
    got = read(CREATE + f"INSERT INTO `t` VALUES (1,'{text}',1);\n").tables["t"].first()
    assert got["name"] == "\n'" * 200_000


@pytest.mark.parametrize("text", [";", ");", "x; INSERT INTO y", "1),(2", "`q`", "-- no comment", "/* nor this */", "(((", ",,,"])
def test_structure_characters_inside_strings(read, text):
    got = read(CREATE + f"INSERT INTO `t` VALUES (1,'{text}',1),(2,'{text}{text}',NULL);\nINSERT INTO `t` VALUES (3,'{text}',2);\n").tables["t"]
    assert [r["name"] for r in got.orderBy("id").collect()] == [text, text * 2, text]


def test_names_with_backquotes_and_odd_columns(read):
    text = ("CREATE TABLE IF NOT EXISTS `odd``name` (`a,b` int(11) COMMENT 'x, `y` z', `c``d` decimal(8, 2) unsigned, `e` enum('(','`',','),\n KEY `k` (`a,b`,`e`), CHECK (`a,b` > (0)));\n"
            "INSERT INTO `odd``name` VALUES (1,2.50,'(');\n")
    got = read(text).tables["odd`name"]
    assert got.dtypes == [("a,b", "int"), ("c`d", "decimal(8,2)"), ("e", "string")] and [tuple(map(str, r)) for r in got.collect()] == [("1", "2.50", "(")]


def test_other_line_ends(spark, read):
    text = CREATE.replace("\n", "\r\n") + "".join(f"INSERT INTO `t` VALUES ({i},'a\\r\\nb',{i});\r\n" for i in range(50))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = read(text).tables["t"]
        assert got.count() == 50 and got.select("name").distinct().first()[0] == "a\r\nb"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_packed_files(spark, tmp_path):
    data = (CREATE + "INSERT INTO `t` VALUES (1,'a',2),(2,'b',3);\n").encode()
    (tmp_path / "d.sql.gz").write_bytes(gzip.compress(data))
    assert dump.read_dump(spark, str(tmp_path / "d.sql.gz")).tables["t"].count() == 2
    (tmp_path / "e.sql.gz").write_bytes(gzip.compress(data)[:-12])
    with pytest.raises(Exception):
        dump.read_dump(spark, str(tmp_path / "e.sql.gz"))
    with pytest.raises(dump.DumpError, match="unpack"):
        dump.read_dump(spark, "/in/data_20250101.tar.gz")


def test_comments_bookkeeping_and_interleaving(read):
    text = ("-- header\n/*!40101 SET x = 1 */;\nSET a = 1;\nLOCK TABLES `a` WRITE;\n"
            "-- Table\n/*!40101 SET y */ CREATE TABLE `a` (`x` int(11));\n/* block ; */ CREATE TABLE `b` (`x` int(11), `y` decimal(10,2), `k` enum('u','v'));\n"
            "-- data\nINSERT INTO `a` VALUES (1);\nINSERT INTO `b` VALUES (1,1.25,'u');\ninsert into `a` values (2),(3);\nUNLOCK TABLES;\n-- Dump completed")
    got = read(text)
    assert rows(got.tables["a"]) == [(1,), (2,), (3,)]
    assert got.tables["b"].dtypes == [("x", "int"), ("y", "decimal(10,2)"), ("k", "string")]


def test_several_statements_on_one_line(read):
    got = read("CREATE TABLE `a` (`x` int(11)); INSERT INTO `a` VALUES (1); INSERT INTO `a` VALUES (2);")
    assert rows(got.tables["a"]) == [(1,), (2,)]


@pytest.mark.parametrize("text,match", [
    (CREATE + "INSERT IGNORE INTO `t` VALUES (1,'a',1);\n", "unknown INSERT form"),
    (CREATE + "INSERT INTO `t` (id) VALUES (1);\n", "unknown INSERT form"),
    (CREATE + "INSERT INTO `t` VALUES (5,'z',8) ON DUPLICATE KEY UPDATE `id` = 5;\n", "not a list"),
    (CREATE + "INSERT INTO `t` VALUES (5,'z',now());\n", "not a list"),
    (CREATE + "INSERT INTO `t` VALUES (5,x'7a',8);\n", "not a list"),
    (CREATE + "INSERT INTO `t` VALUES (1,'a';\n", "not a list"),
    (CREATE + "INSERT INTO `t` VALUES (1,'a);\n", "not a list|truncated"),
    (CREATE + "INSERT INTO `t` VALUES (1,'a');\n", "number of values"),
    (CREATE + "INSERT INTO `t` VALUES (1,'a',2", "truncated"),
    (CREATE + "INSERT INTO `t` VALUES (1,'a',2)", "truncated"),
    (CREATE + "INSERT INTO `u` VALUES (1);\n", "undeclared table"),
    ("CREATE TABLE `t` (PRIMARY KEY (`x`));\n", "no columns"),
    (CREATE.encode() + b"INSERT INTO `t` VALUES (1,'\xff\xfe',2);\n", "UTF-8"),
    (CREATE + "/* never closed\n", "unterminated|truncated"),
    ("", "no tables"),
    ("-- nothing here\n/* still nothing */\n   ;\n", "no tables"),
])
def test_nothing_is_dropped_silently(read, text, match):
    with pytest.raises(dump.DumpError, match=match):
        read(text)


def test_rejects_can_be_kept(read):
    long = "w" * 300
    got = read(CREATE + f"INSERT INTO `t` VALUES (8,'k',2),(9,'l',today),(10,'{long}'),('no','m',1);\nINSERT INTO `gone` VALUES ('{long}');\n", on_reject="keep")
    assert rows(got.rejected.select("table", "row_no", "reason")) == [
        ("gone", 0, "row of an undeclared table"), ("t", -1, "not a list of VALUES tuples"), ("t", 1, "number of values differs from the columns")]
    assert all(long in r["sample"] for r in got.rejected.collect())       # rejected items are kept whole
    assert rows(got.tables["t"]) == [(None, "m", 1.0), (8, "k", 2.0)]
    assert rows(got.bad_casts()) == [("t", "id", 1)]


def test_a_value_of_the_wrong_type_stops_the_reader(read):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read(CREATE + "INSERT INTO `t` VALUES ('x','d',1);\n").tables["t"].collect()


def test_normalisation_and_skips(read):
    text = ("CREATE TABLE `v` (`b` bit(1), `d` date, `ts` datetime, `n` tinyint(1));\nCREATE TABLE `sys__x` (`a` int(11));\nCREATE TABLE `USERS` (`a` int(11));\n"
            "INSERT INTO `v` VALUES ('\\0','0000-00-00','0000-00-00 00:00:00',1),('\x01','2024-01-15','2024-01-15 12:30:00',0);\n"
            "INSERT INTO `sys__x` VALUES (1);\nINSERT INTO `USERS` VALUES (1);\n")
    got = read(text, internal_prefix="sys__", skip_tables=dump.OPERATIONAL_TABLES)
    assert got.skipped == ("USERS", "sys__x") and list(got.tables) == ["v"]
    assert rows(got.tables["v"]) == [(False, None, None, 1), (True, dt.date(2024, 1, 15), dt.datetime(2024, 1, 15, 12, 30), 0)]


def test_splits_do_not_change_the_result(spark, read):
    text = CREATE + "".join(f"INSERT INTO `t` VALUES ({i},'row; {i}\\n',{i}.5),({i + 1000},NULL,NULL);\n" for i in range(500))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = read(text).tables["t"]
        assert got.count() == 1000 and got.select("id").distinct().count() == 1000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("mysql,expected", [
    ("tinyint(1)", "smallint"), ("smallint(6)", "smallint"), ("mediumint(9)", "int"), ("int(11)", "int"), ("INT", "int"), ("bigint(20)", "bigint"),
    ("int(10) unsigned", "bigint"), ("bigint(20) unsigned", "decimal(20,0)"), ("double", "double"), ("float", "double"),
    ("decimal(10,2)", "decimal(10,2)"), ("numeric(5,0)", "decimal(5,0)"), ("varchar(255)", "string"), ("char(1)", "string"), ("longtext", "string"),
    ("text", "string"), ("enum('a','b')", "string"), ("set('x')", "string"), ("date", "date"), ("datetime", "timestamp_ntz"),
    ("timestamp", "timestamp_ntz"), ("time", "string"), ("varbinary(16)", "binary"), ("blob", "binary"), ("bit(1)", "boolean"), ("bit(8)", "binary")])
def test_types(mysql, expected):
    got = spark_type(mysql).simpleString()
    assert got == expected and spark_type(got).simpleString() == expected


def test_unknown_type():
    with pytest.raises(ValueError):
        spark_type("geometry")


def sheet(spark, data, extra=()):
    cols = [*dc.HEADER, *extra]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))


def row(table="T", column="c", key="", fmt="Long", null="", *more):
    return ("1", "", "", table, column, key, fmt, null, "", "", *more)


def test_dictionary(spark):
    got = dc.load_dictionary(sheet(spark, [row(key="Primary"), row(column="d", fmt="binary", null="No"), row(column="e", fmt=" "), row(table=" ")]))
    assert rows(got.select("column", "format", "spark_type", "nullable", "is_key")) == [
        ("c", "Long", "int", True, True), ("d", "Binary", "binary", False, False), ("e", None, None, True, False)]


@pytest.mark.parametrize("data,extra,match", [
    ([row(), row()], (), "duplicate"), ([row(fmt="Weird")], (), "unknown format"), ([row(null="perhaps")], (), "yes/no"),
    ([row("T", "c", "", "Long", "", "stray")], ("Extra",), "beyond")])
def test_dictionary_errors(spark, data, extra, match):
    with pytest.raises(dc.DictionaryError, match=match):
        dc.load_dictionary(sheet(spark, data, extra))


def test_dictionary_header(spark):
    with pytest.raises(dc.DictionaryError, match="header"):
        dc.load_dictionary(spark.createDataFrame([("a",)], "x string"))


def test_latest_dump(spark):
    names = lambda *n: spark.createDataFrame([(f"/in/{x}",) for x in n], "path string")
    got = dump.latest_dump(names("data_20250101.tar.gz", "data_20260520.tar.gz", "data_20270101.7z", "other_20280101.tar.gz"), "data_").first()
    assert got["date_tag"] == "20260520"
    with pytest.raises(dump.DumpError, match="several"):
        dump.latest_dump(spark.createDataFrame([("/a/data_20250101.tar.gz",), ("/b/data_20250101.tar.gz",)], "path string"), "data_")
    with pytest.raises(dump.DumpError, match="no data_"):
        dump.latest_dump(names("x.rar"), "data_")
    # one that can be read is taken as it is; of one day's dumps the first suffix
    some = names("data_20260520.tar.gz", "data_20260101.sql.gz", "data_20260101.sql", "data_20251231.sql", "data_20260101xsql")
    assert dump.latest_dump(some, "data_", dump.READABLE).first()["path"] == "/in/data_20260101.sql"
    assert dump.latest_dump(some, "data_", (".sql.gz", ".sql")).first()["path"] == "/in/data_20260101.sql.gz"
    assert dump.latest_dump(some, "data_", (*dump.READABLE, ".tar.gz")).first()["date_tag"] == "20260520"
    assert dump.latest_dump(some, "data_").columns == ["path", "date_tag"]
    with pytest.raises(dump.DumpError, match="no data_"):
        dump.latest_dump(names("data_20260520.tar.gz"), "data_", dump.READABLE)


def test_the_newest_dump_is_chosen_and_read(spark, tmp_path):
    insert = lambda n: f"CREATE TABLE `t` (\n  `id` int(11) DEFAULT NULL\n);\nINSERT INTO `t` VALUES ({n});\n".encode()
    (tmp_path / "d_20250101.sql").write_bytes(insert(1))
    (tmp_path / "d_20260101.sql.gz").write_bytes(gzip.compress(insert(2)))
    (tmp_path / "d_20270101.tar.gz").write_bytes(b"not a dump")
    path = dump.latest_dump(dump.list_files(spark, str(tmp_path)), "d_", dump.READABLE).first()["path"]
    assert rows(dump.read_dump(spark, path).tables["t"]) == [(2,)]


def test_build_and_fingerprints(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    got = tables.write_tables({"a": a, "b": a.limit(0)}, str(tmp_path), ["z"]).first()
    assert tuple(got) == (2, 2, ["z"])
    again = spark.read.parquet(f"{tmp_path}/a")
    for digest in ("xxhash64", "md5"):
        one = tables.fingerprint(a, digest).first()
        assert one == tables.fingerprint(again.orderBy("i", ascending=False), digest).first()
        assert one != tables.fingerprint(a.fillna("x"), digest).first()
        moved = spark.createDataFrame([(None, "q")], "i string, s string"), spark.createDataFrame([("q", None)], "i string, s string")
        assert tables.fingerprint(moved[0], digest).first() != tables.fingerprint(moved[1], digest).first()
    one, two = (spark.createDataFrame([("ab", "c"), ("a", "bc")][i:i + 1], "i string, s string") for i in (0, 1))
    assert tables.fingerprint(one, "md5").first() != tables.fingerprint(two, "md5").first()
    border = spark.createDataFrame([("x\x1f1=y", None)], "i string, s string"), spark.createDataFrame([("x", "y")], "i string, s string")
    assert tables.fingerprint(border[0], "md5").first() != tables.fingerprint(border[1], "md5").first()


def test_file_hashes(spark, tmp_path):
    for name, data in (("a", b"one\ntwo\n"), ("b", b"two\none\n"), ("c", b"one\ntwa\n"), ("d", b"\xff\x00\nend")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-1]: (r["length"], r["lines"], r["hash_sum"], r["hash_xor"]) for r in tables.file_hashes(spark, str(tmp_path)).collect()}
    assert got["a"][:2] == got["b"][:2] == (8, 2) and len({got["a"], got["b"], got["c"]}) == 3 and got["d"][:2] == (6, 2)


@pytest.mark.parametrize("size", ["200b", "1g"])
def test_file_hashes_know_the_order_whatever_the_splits(spark, tmp_path, size):
    """Lines of many splits are numbered through; the same file gives the same hashes however it is split."""
    lines = [f"row {i % 7} {'x' * (i % 40)}".encode() for i in range(500)]
    for name, data in (("a", lines), ("b", lines[:-2] + lines[:-3:-1]), ("e", [])):
        (tmp_path / name).write_bytes(b"".join(x + b"\n" for x in data))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {r["path"][-1]: r for r in tables.file_hashes(spark, str(tmp_path), "md5").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [int(hashlib.md5(b"%d:%s" % (i + 1, x)).hexdigest()[:15], 16) for i, x in enumerate(lines)]
    assert got["a"]["lines"] == 500 and int(got["a"]["hash_sum"]) == sum(want)
    assert got["b"]["lines"] == 500 and got["b"]["hash_sum"] != got["a"]["hash_sum"] and got["b"]["length"] == got["a"]["length"]
    assert "e" not in got


def test_recorded_builds(spark, tmp_path):
    stats = spark.createDataFrame([(3, 40, ["z"])], "tables_created bigint, rows_inserted bigint, tables_skipped array<string>")
    for product, done in (("a", None), ("a", stats), ("b", None), ("c", None), ("c", stats), ("c", None)):
        tables.record_build(spark, str(tmp_path), product, "s1", f"/{product}", "1", done)
    known = tables.read_provenance(spark, str(tmp_path))
    assert rows(known.select("product", "tables", "rows", "started")) == [("a", 3, 40, False), ("b", None, None, True), ("c", None, None, True)]
    want = known.select("product", "source_sha", "path", "builder_version", F.lit(1).alias("file_bytes"))
    assert rows(tables.reusable(known, want).select("product")) == [("a",)]


def test_provenance(spark):
    p = spark.createDataFrame([("a", "s1", "/a", "1"), ("b", "s1", "/b", "1")], "product string, source_sha string, path string, builder_version string")
    want = spark.createDataFrame([("a", "s1", "/a", "1", 10), ("b", "s1", "/b", "2", 10)],
                                 "product string, source_sha string, path string, builder_version string, file_bytes long")
    assert rows(tables.reusable(p, want).select("product")) == [("a",)]
    assert rows(tables.reusable(p, want.withColumn("file_bytes", F.lit(0)))) == []
    assert tables.current_provenance(p, "s2").count() == 0
    assert rows(tables.after_failure(p, spark.createDataFrame([("b",)], "product string")).select("product")) == [("a",)]
    assert tuple(tables.same_source(p, "a", "b", {"a": "/a"}).first()) == (True, True, True)
    assert tuple(tables.same_source(p, "a", "missing").first())[2] is False


def test_jdbc_options():
    o = jdbc.table_options("jdbc:mysql://h/db", "BIOG_MAIN", ("c_personid", 1, 600000, 64), {"user": "u"})
    assert o == {"url": "jdbc:mysql://h/db", "dbtable": "BIOG_MAIN", "fetchsize": "10000", "user": "u", "partitionColumn": "c_personid",
                 "lowerBound": "1", "upperBound": "600000", "numPartitions": "64"}
    with pytest.raises(ValueError, match="split"):
        jdbc.read_table(None, "jdbc:mysql://h/db", "BIOG_MAIN")
    assert "BASE TABLE" in jdbc.listing_query("db") and "'d''b'" in jdbc.listing_query("d'b")


def test_lists(spark, tmp_path):
    (tmp_path / "codes.txt").write_text("36\tjinshi\n7\tx\n\n")
    (tmp_path / "places.txt").write_text("10, 11,12\n")
    assert rows(lists.read_codes(spark, str(tmp_path / "codes.txt"))) == [(36,), (7,)]
    assert rows(lists.read_places(spark, str(tmp_path / "places.txt"))) == [(10,), (11,), (12,)]


def test_dump_text_is_read_in_small_splits(spark, tmp_path, monkeypatch):
    from prosopo.sources import dump
    text = "CREATE TABLE `v` (`id` bigint(20));\n" + "".join(f"INSERT INTO `v` VALUES ({i});\n" for i in range(4000))
    (tmp_path / "d.sql").write_text(text)
    monkeypatch.setattr(dump, "SPLIT_BYTES", 20_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = dump.read_dump(spark, str(tmp_path / "d.sql"), stage=str(tmp_path / "stage"))
    assert got.tables["v"].count() == 4000 and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert len(list((tmp_path / "stage/role=row/table=v").glob("*.parquet"))) >= len(text) // 20_000
