"""Database dump text to typed tables.

A dump is read as one statement per record (``;`` + line end ends a statement, and
inside strings newlines are escaped), so a file splits into tasks wherever Spark
cuts it. The line end is that of the dump's first line. A ``.gz`` file cannot be split:
it is one task, and its codec tells whether it is whole. A tar archive is refused; unpack it first. Tokenising is done by built-in regular-expression functions; the patterns
are possessive, so long statements neither backtrack nor recurse.

Nothing is dropped silently: whatever does not fit becomes a rejected row with a
reason, and by default stops the job.
"""
from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from prosopo.catalog import Catalog
from prosopo.session import new_folder
from prosopo.sources.types import table_schema

STRING = r"'(?:[^'\\]++|\\.)*+'"
BARE = r"(?:NULL|null|[+-]?(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?)?"
NOISE = r"(?s)^(?:\s++|--[^\n]*+(?:\n|$)|/\*.*?\*/)*+"
# a quoted name holds anything, a backquote doubled; heads are a keyword phrase and such a name
NAME = r"`((?:[^`]|``)++)`"
CREATE = rf"(?is)^CREATE\b(?:\s++TEMPORARY)?+\s++TABLE\b(?:\s++IF\s++NOT\s++EXISTS)?+\s*+{NAME}\s*+\("
INSERT = rf"(?is)^INSERT\b\s*+INTO\b\s*+{NAME}\s*+VALUES\b\s*+"
# the block of a CREATE is a comma list of entries; nested brackets, texts and names are each one piece
ENTRY = rf"(?s)(?:{STRING}|`[^`]*+`|\((?:{STRING}|[^()'])*+\)|[^,()'`])++"
# an entry that begins with a name is a column: the name, a type word, its arguments, its sign
COLUMN = rf"(?is)^\s*+{NAME}\s++([a-z]\w*+(?:\s*+\([^)]*+\))?+(?:\s++unsigned\b)?+)"
VALUE = rf"(?s)(?:{STRING}|{BARE})"
TUPLE = rf"(?s)\(\s*+{VALUE[4:]}\s*+(?:,\s*+{VALUE[4:]}\s*+)*+\)"
ITEM = rf"(?s)[(,]\s*+({VALUE[4:]})"
STATEMENT = rf"(?s)(?:{STRING}|`[^`]*+`|--[^\n]*+|/\*.*?\*/|[^;'`])++"

# fixed values: two-character escapes with a meaning of their own; any other
# escaped character stands for itself
ESCAPES = (("\\0", "\x00"), ("\\b", "\x08"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\Z", "\x1a"))
ZERO_DATES = ("0000-00-00 00:00:00", "0000-00-00")
# fixed values: tables of the serving application, never part of the data
OPERATIONAL_TABLES = (
    "users", "operations", "password_resets", "personal_access_tokens", "pinyin", "migrations",
    "oauth_access_tokens", "oauth_auth_codes", "oauth_clients", "oauth_personal_access_clients",
    "oauth_refresh_tokens", "audit_log", "ai_fill_logs", "nl_query_logs", "addresses",
)


#: a task sorts all literals of its split by table, some thirty times the text in memory
SPLIT_BYTES = 16 << 20


class DumpError(ValueError):
    """The dump holds something that would be lost or guessed."""


def latest_dump(files: DataFrame, prefix: str, suffix: str | Sequence[str] = ".tar.gz") -> DataFrame:
    """The file whose name carries the largest 8-digit date tag (never the newest by mtime).

    ``files`` has a ``path`` column. Other names are ignored; none, or two with one tag and suffix,
    is an error. Of several suffixes the first is preferred where a tag has more than one, e.g. ``READABLE``, which :func:`read_dump` takes as they are.
    """
    suffixes = [suffix] if isinstance(suffix, str) else list(suffix)
    escape = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    name = F.element_at(F.split("path", "/"), -1)
    tags = [F.regexp_extract(name, f"^{escape(prefix)}(\\d{{8}}){escape(x)}$", 1) for x in suffixes]
    rank = F.coalesce(*[F.when(t != "", F.lit(i)) for i, t in enumerate(tags)])
    tagged = files.withColumn("date_tag", F.concat(*tags)).withColumn("__rank", rank).where("__rank is not null")
    twice = tagged.groupBy("date_tag", "__rank").count().where("count > 1").take(1)
    if twice:
        raise DumpError(f"several dumps carry the tag {twice[0]['date_tag']}")
    newest = tagged.orderBy(F.desc("date_tag"), "__rank").limit(1).drop("__rank")
    if not newest.take(1):
        raise DumpError(f"no {prefix}YYYYMMDD{' or '.join(suffixes)} found")
    return newest


READABLE = (".sql", ".sql.gz")      #: suffixes of dumps that need no unpacking


def list_files(spark: SparkSession, folder: str, parts: bool = False) -> DataFrame:
    """(path, length) of the files in a folder, or with ``parts`` of the folders in it that hold a dump in parts; their content is not read."""
    files = spark.read.format("binaryFile").load(f"{folder}/*" if parts else folder).select("path", "length")
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.sum("length").alias("length")) if parts else files


def _name(statement: str, head: str) -> Column:
    return F.replace(F.regexp_extract(statement, head, 1), F.lit("``"), F.lit("`"))


def _entries(create: str) -> Column:
    """The column entries of a CREATE statement, in order."""
    found = F.regexp_extract_all(F.regexp_replace(create, CREATE, ""), F.lit(ENTRY), F.lit(0))
    return F.filter(found, lambda e: F.regexp_like(e, F.lit(COLUMN)))


def separator(spark: SparkSession, path: str | Sequence[str]) -> str:
    """What ends a statement: ``;`` and the line end of the first line."""
    paths = [path] if isinstance(path, str) else list(path)
    if any(p.lower().endswith((".tar", ".tar.gz", ".tgz", ".zip", ".7z")) for p in paths):
        raise DumpError(f"{paths}: an archive; unpack it and give its .sql file")
    first = spark.read.text(paths, lineSep="\n").limit(1).collect()
    return ";\r\n" if first and first[0]["value"].endswith("\r") else ";\n"


def _statements(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per statement: file, file_size, at (place in the file), bytes, closed, kind, table,
    body, tuples (of an INSERT), left_over (what is neither tuple nor separator), reason.

    ``bytes`` is set once per record (record plus separator), so that the bytes of a
    file add up to its size exactly if its last record is closed.
    """
    end = separator(spark, path)
    raw = (spark.read.text(path, lineSep=end)
           .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
                   F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("record")))
    stripped = F.rtrim(F.col("value"), F.lit(" \t\r\n"))
    raw = (raw.withColumn("closed", F.endswith(stripped, F.lit(";")))
           .withColumn("text", F.when(F.col("closed"), F.substring(stripped, F.lit(1), F.length(stripped) - 1)).otherwise(F.col("value")))
           .withColumn("valid", F.is_valid_utf8("value")).withColumn("bytes", (F.octet_length("value") + len(end)).cast("bigint")))
    # the usual record is one INSERT whose tuples, joined by commas, are all of it: one regular expression
    head = F.when(F.startswith("text", F.lit("INSERT INTO `")), F.regexp_extract("text", INSERT, 0))
    raw = raw.withColumn("head", head)
    raw = raw.withColumn("tail", F.when(F.col("head") != "", F.substring(F.col("text"), F.length("head") + 1, F.length("text"))))
    raw = raw.withColumn("tuples", F.regexp_extract_all("tail", F.lit(TUPLE), F.lit(0)))
    plain = F.coalesce(F.array_join("tuples", ",") == F.col("tail"), F.lit(False))
    # any other record is cleaned of comments; several statements on one line are taken apart
    found = F.regexp_extract_all("text", F.lit(STATEMENT), F.lit(0))
    parts = F.when(plain, F.array("head")).when(F.contains("text", F.lit(";")) & (F.size(found) > 0), found).otherwise(F.array("text"))
    part = raw.withColumn("plain", plain).select(
        "file", "file_size", "block", "record", "valid", "bytes", "closed", "plain", F.when(F.col("plain"), F.col("tuples")).alias("tuples"),
        F.posexplode(parts).alias("part", "raw"))
    part = part.withColumn("body", F.when(F.col("plain"), F.col("raw")).otherwise(F.regexp_replace("raw", NOISE, "")))
    kind = (F.when(F.regexp_like("body", F.lit(CREATE)), "create").when(F.regexp_like("body", F.lit(INSERT)), "insert")
            .when(F.regexp_like("body", F.lit(r"^\s*$")), "blank").otherwise("other"))
    part = part.withColumn("kind", kind)
    tail = F.when((F.col("kind") == "insert") & ~F.col("plain"), F.regexp_replace("body", INSERT, ""))
    part = part.withColumn("tail", tail)
    part = part.withColumn("tuples", F.coalesce("tuples", F.regexp_extract_all("tail", F.lit(TUPLE), F.lit(0)),
                                                F.array().cast("array<string>")))
    left_over = F.regexp_replace(F.regexp_replace("tail", TUPLE, ""), r"[\s,;]+", "")
    part = part.withColumn("left_over", left_over)
    reason = (F.when(~F.col("valid"), "not valid UTF-8")
              .when((F.col("kind") == "other") & (F.upper(F.substring("body", 1, 6)) == "INSERT"), "unknown INSERT form")
              .when((F.col("kind") == "other") & F.startswith("body", F.lit("/*")), "unterminated comment")
              .when((F.col("kind") == "create") & (F.size(_entries("body")) == 0), "no columns")
              .when((F.col("left_over") != "") | ((F.col("kind") == "insert") & (F.size("tuples") == 0)), "not a list of VALUES tuples"))
    table = F.when(F.col("kind") == "create", _name("body", CREATE)).when(
        F.col("kind") == "insert", _name("body", INSERT))
    return part.select("file", "file_size", F.struct("block", "record", "part").alias("at"),
                       F.when(F.col("part") == 0, F.col("bytes")).alias("bytes"), "closed", "kind",
                       F.coalesce(table, F.lit("?")).alias("table"), "body", "tuples", "left_over", reason.alias("reason"))


def _with_splits(spark: SparkSession, most: int) -> SparkSession:
    """A session with the settings of ``spark`` that reads files in splits of at most ``most`` bytes; the caller's own is not changed."""
    own, name = spark.newSession(), "spark.sql.files.maxPartitionBytes"
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", own.conf.get(name).strip().lower()).groups()
    own.conf.set(name, str(min(most, int(number) << 10 * " kmgtp".index(unit or " "))))
    return own


def tokenise(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All statements and INSERT tuples of the dump in one pass over the text.

    ``role`` "statement" rows describe a statement (``item``: the whole text of a CREATE and of what
    is rejected, else the last 200 characters); ``role`` "row" rows are tuples cut into literals,
    which are decoded when their table is read. ``reason`` marks what must not pass.
    """
    s = _statements(spark, path)
    info = (F.when((F.col("kind") == "create") | F.col("reason").isNotNull(), F.col("body"))
            .otherwise(F.substring("body", -200, 200)))
    s = s.select("file", "file_size", "at", "bytes", "closed", "kind", "table", "reason",
                 F.posexplode(F.concat(F.array(info), "tuples")).alias("pos", "item"))
    first = F.col("pos") == 0
    tokens = F.when(~first, F.regexp_extract_all("item", F.lit(ITEM), F.lit(1)))
    return s.select(
        "file", F.when(first, F.col("file_size")).alias("file_size"), "at", F.when(first, F.col("bytes")).alias("bytes"),
        F.when(first, F.col("closed")).alias("closed"), "kind", (F.col("pos") - 1).alias("row_no"),
        F.when(first, F.col("item")).alias("item"), tokens.alias("tokens"),
        F.when(first, F.col("reason")).alias("reason"), F.when(first, "statement").otherwise("row").alias("role"), "table")


def unfinished_files(statements: DataFrame) -> DataFrame:
    """Files whose last statement is never closed: (file, tail).

    Where the bytes show that the last separator is missing, what follows the one
    before must be empty, comments only, or end in ``;``.
    """
    last = F.max(F.struct("at", "kind", "closed", "item"))
    per_file = statements.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.max("file_size").alias("size"), last.alias("last"))
    packed = F.endswith(F.lower("file"), F.lit(".gz"))       # its size is not that of the text; its codec notices a cut
    return (per_file.where(~packed & (F.col("bytes") != F.col("size")) & (F.col("last.kind") != "blank") & ~F.col("last.closed"))
            .select("file", F.col("last.item").alias("tail")))


def dump_columns(statements: DataFrame) -> DataFrame:
    """(table, position, column, mysql_type) from the CREATE TABLE statements."""
    return (statements.where("kind = 'create'").select("table", F.posexplode(_entries("item")).alias("position", "entry"))
            .select("table", "position", _name("entry", COLUMN).alias("column"), F.regexp_extract("entry", COLUMN, 2).alias("mysql_type")))


def decode_literal(token: Column) -> Column:
    """Value of one literal as text: NULL for NULL, unescaped text for strings, digits for numbers."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)

    def plain(piece: Column) -> Column:
        for escape, char in ESCAPES:
            piece = F.replace(piece, F.lit(escape), F.lit(char))
        return F.regexp_replace(piece, r"(?s)\\(.)", "$1")

    # an escaped backslash is always two in a row, so cutting there leaves whole escapes
    pieces = F.transform(F.split(inner, r"\\\\"), plain)
    text = F.when(F.contains(inner, F.lit("\\")), F.array_join(pieces, "\\")).otherwise(inner)
    return F.when(F.startswith(token, F.lit("'")), text).when(F.upper(token).isin("NULL", ""), None).otherwise(token)


def normalise(value: Column, zero_dates: bool = True) -> Column:
    """One-bit characters become 0 and 1; zero dates become NULL."""
    value = F.when(value == "\x00", "0").when(value == "\x01", "1").otherwise(value)
    return F.when(~value.isin(*ZERO_DATES), value) if zero_dates else value


@dataclass(frozen=True)
class Dump:
    tables: Catalog
    columns: DataFrame      # table, position, column, mysql_type
    rejected: DataFrame     # table, file, at, row_no, reason, sample (the whole row or statement)
    skipped: tuple[str, ...]
    literals: dict[str, tuple[DataFrame, list[tuple[str, str]]]]   # per table: cut but undecoded rows, columns

    def bad_casts(self) -> DataFrame:
        """(table, column, bad): how many values do not fit their column's type."""
        out = None
        for table, (rows, columns) in self.literals.items():
            one = _bad_casts(table, rows, columns)
            out = one if out is None else out.unionByName(one)
        return out


def read_dump(spark: SparkSession, path: str | Sequence[str], on_reject: str = "error",
              internal_prefix: str | None = None, skip_tables: Sequence[str] = (),
              overlay: DataFrame | None = None, stage: str | None = None) -> Dump:
    """Dump files to a catalog of typed tables.

    The text is tokenised once and staged by table; checks and typing read the stage,
    so their number does not multiply the parsing. ``internal_prefix`` and
    ``skip_tables`` (any case) name tables left out. ``overlay`` is a column
    dictionary whose formats win over the dump's types.

    With ``on_reject="error"`` anything unreadable stops here, and a value that does not
    fit its column's type stops whoever reads the table. With "keep" the former are
    listed in ``rejected``, the latter become NULL and are counted by ``bad_casts()``.
    """
    if on_reject not in ("error", "keep"):
        raise ValueError("on_reject must be 'error' or 'keep'")
    stage = stage or new_folder(spark, "dump")
    tokens = tokenise(_with_splits(spark, SPLIT_BYTES), path)
    tokens.write.partitionBy("role", "table").parquet(stage)
    staged = spark.read.schema(tokens.schema).parquet(stage)
    statements, rows = staged.where("role = 'statement'"), staged.where("role = 'row'")

    unfinished = unfinished_files(statements).take(1)
    if unfinished:
        raise DumpError(f"truncated dump {unfinished[0]['file']}: {unfinished[0]['tail'][:80]!r}")
    columns = dump_columns(statements)
    skip = {t.lower() for t in skip_tables}
    formats = {} if overlay is None else {
        (r["table"], r["column"]): r["spark_type"]
        for r in overlay.where("spark_type is not null").select("table", "column", "spark_type").collect()}
    by_table: dict[str, list[tuple[str, str]]] = {}
    skipped: set[str] = set()
    for r in columns.orderBy("table", "position").collect():  # metadata: one row per declared column
        t = r["table"]
        if t.lower() in skip or (internal_prefix and t.startswith(internal_prefix)):
            skipped.add(t)
        else:
            by_table.setdefault(t, []).append((r["column"], formats.get((t, r["column"]), r["mysql_type"])))

    wanted = ~F.col("table").isin(sorted(skipped)) if skipped else F.lit(True)
    widths = F.create_map(*[F.lit(x) for t, c in by_table.items() for x in (t, len(c))]) if by_table else \
        F.create_map().cast("map<string,int>")
    width = F.try_element_at(widths, F.col("table"))
    reason = (F.when(F.col("reason").isNotNull(), F.col("reason"))
              .when((F.col("role") == "row") & width.isNull(), "row of an undeclared table")
              .when((F.col("role") == "row") & (F.size("tokens") != width), "number of values differs from the columns"))
    rejected = (staged.where(wanted).withColumn("reason", reason).where("reason is not null").select(
        "table", "file", "at", "row_no", "reason",
        F.coalesce("item", F.array_join("tokens", ",", "NULL")).alias("sample")))
    if on_reject == "error":
        bad = rejected.take(1)
        if bad:
            raise DumpError(f"{bad[0]['table']}: {bad[0]['reason']}: {bad[0]['sample'][:200]!r}")
    if not by_table:
        raise DumpError("the dump declares no tables")
    good = {t: rows.where((F.col("table") == t) & (F.size("tokens") == len(c))) for t, c in by_table.items()}
    strict = on_reject == "error"
    tables = {t: _typed(good[t], c, strict) for t, c in by_table.items()}
    return Dump(Catalog(tables), columns, rejected, tuple(sorted(skipped)), {t: (good[t], by_table[t]) for t in good})


def _value(i: int, t: T.DataType, strict: bool) -> Column:
    v = normalise(decode_literal(F.get("tokens", F.lit(i))))
    if isinstance(t, T.BooleanType):
        return (v.cast("int") if strict else v.try_cast("int")).cast("boolean")
    if strict or isinstance(t, (T.StringType, T.BinaryType)):
        return v.cast(t)
    return v.try_cast(t)


def _typed(rows: DataFrame, columns: list[tuple[str, str]], strict: bool) -> DataFrame:
    return rows.select(*[_value(i, f.dataType, strict).alias(f.name) for i, f in enumerate(table_schema(columns).fields)])


def _bad_casts(table: str, rows: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    fields = table_schema(columns).fields
    lost = [F.count_if(normalise(decode_literal(F.get("tokens", F.lit(i)))).isNotNull() & _value(i, f.dataType, False).isNull()).alias(f"n{i}")
            for i, f in enumerate(fields)]
    return (rows.agg(*lost).select(F.explode(F.arrays_zip(
        F.array(*[F.lit(f.name) for f in fields]).alias("column"), F.array(*[F.col(f"n{i}") for i in range(len(fields))]).alias("bad"))).alias("c"))
        .select(F.lit(table).alias("table"), "c.column", "c.bad").where("bad > 0"))
