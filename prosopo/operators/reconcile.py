"""Comparison of two datasets: by key, by position, by row count, by schema."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prosopo.functions.exprs import nan_to_null
from prosopo.operators.aggregates import table_counts
from prosopo.operators.ordering import nulls_first, with_ordinal, with_position
from prosopo.session import cut_lineage

_MASK_BITS = 62
BUCKETS = ("match", "mismatch", "only_left", "only_right")


def _family(t: T.DataType) -> str:
    if isinstance(t, (T.NumericType, T.BooleanType)):
        return "number"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return t.simpleString()


def _plain(c: Column, t: T.DataType) -> Column:
    return c.cast("int") if isinstance(t, T.BooleanType) else c


def same_value(left: Column, lt: T.DataType, right: Column, rt: T.DataType) -> Column:
    """Equality as the report means it: NULL equals NULL, numbers compare by value
    whatever their types, and a number never equals a text."""
    if isinstance(lt, T.NullType) or isinstance(rt, T.NullType) or _family(lt) != _family(rt):
        return left.isNull() & right.isNull()
    left, right = _plain(left, lt), _plain(right, rt)
    whole, real = (T.IntegralType, T.BooleanType), (T.DoubleType, T.FloatType)
    if isinstance(lt, T.DecimalType) != isinstance(rt, T.DecimalType):
        # a decimal against another kind of number: exactly, as text
        return exact_text(left, lt).eqNullSafe(exact_text(right, rt))
    if isinstance(lt, real) and isinstance(rt, whole):
        return same_value(right, rt, left, lt)
    if isinstance(lt, whole) and isinstance(rt, real):
        # a 64-bit whole number may round when widened; the way back must agree too
        return left.cast("double").eqNullSafe(right) & right.try_cast("bigint").eqNullSafe(left.cast("bigint"))
    return left.eqNullSafe(right)


def _with_columns(df: DataFrame, names: Sequence[str], other: DataFrame) -> DataFrame:
    """Columns a side lacks, as NULLs of the other side's type."""
    types = {f.name: f.dataType for f in other.schema.fields}
    missing = {n: F.lit(None).cast(types.get(n, T.StringType())) for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


_WHOLE, _REAL = (T.IntegralType, T.BooleanType), (T.DoubleType, T.FloatType)


def exact_text(c: Column, t: T.DataType) -> Column:
    """A number as text that is equal exactly where the numbers are: 5, 5.0, 5.00 and true's 1 are whole, 2^53 + 1 is not 2^53.

    A decimal loses its trailing zeros. A real number with a fraction stands for the decimal it is written as - 0.1 equals the decimal
    0.1 - and a float is widened by its own digits. Without exponents as long as the number lies between 1e-18 and 1e20.
    """
    if isinstance(t, _REAL):
        d = c.cast("double") if isinstance(t, T.DoubleType) else c.cast("string").cast("double")
        wide = c.cast("double")
        written = d.cast("string").try_cast("decimal(38,18)")
        # a fraction of more than 18 digits keeps its own text, which no decimal of up to 18 places has
        return (F.when((F.rint(wide) == wide) & (F.abs(wide) < 9.2e18), wide.cast("bigint").cast("string"))
                .when((F.rint(wide) == wide) & (F.abs(wide) < 1e37), wide.cast("decimal(38,0)").cast("string"))
                .when((F.abs(d) < 1e20) & (written.cast("double") == d), _no_zeros(written.cast("string"))).otherwise(d.cast("string")))
    if isinstance(t, T.DecimalType):
        return _no_zeros(c.cast("string")) if t.scale else c.cast("string")
    return _plain(c, t).cast("string")


def _no_zeros(text: Column) -> Column:
    """A decimal's text without an exponent, trailing zeros and a bare point; zero has no sign."""
    cut = F.regexp_replace(F.when(text.contains("E"), F.format_string("%s", text.cast("decimal(38,18)"))).otherwise(text), r"(\.\d*?)0+$", "$1")
    cut = F.regexp_replace(cut, r"\.$", "")
    return F.when(cut == "-0", "0").otherwise(cut)


def _shared_key(left: Column, lt: T.DataType, right: Column, rt: T.DataType) -> tuple[Column, Column]:
    """Both sides of a key in one type in which equality means equality of values. NULL stays NULL."""
    if isinstance(lt, T.NullType) or isinstance(rt, T.NullType):
        other = rt if isinstance(lt, T.NullType) else lt
        return left.cast(other), right.cast(other)
    if _family(lt) != _family(rt):      # a number never equals a text: both are tagged
        tag = lambda c, t: F.concat(F.lit(_family(t) + ":"), c.cast("string"))
        return tag(left, lt), tag(right, rt)
    if isinstance(lt, T.DecimalType) or isinstance(rt, T.DecimalType):
        return (left, right) if lt == rt else (exact_text(left, lt), exact_text(right, rt))
    if isinstance(lt, (*_WHOLE, *_REAL)) and isinstance(rt, (*_WHOLE, *_REAL)):
        if isinstance(lt, _REAL) != isinstance(rt, _REAL):
            return exact_text(left, lt), exact_text(right, rt)
        if isinstance(lt, _WHOLE) and lt != rt:
            return _plain(left, lt).cast("bigint"), _plain(right, rt).cast("bigint")
    return left, right


def diff(left: DataFrame, right: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None,
         on_duplicate: str = "error", order_by: Sequence[str] | None = None, with_rows: bool = False) -> DataFrame:
    """One row per key: the keys, ``bucket`` and ``differing`` (field, left, right).

    Compared are ``compare`` or else all other columns of ``left``; a column a side lacks reads as NULL.
    Keys of different types are compared by value and shown in the common type: whole against real
    numbers as exact text, texts against numbers with their kind. Keys must be unique: ``on_duplicate``
    says what happens if not ("first" and "last" by ``order_by``, ties by the other columns; "trust" skips the check).

    Both sides are stacked and grouped once: rows of a repeated key combine before the one shuffle, so
    no key is hot. The check for repeated keys reads the written groups. ``with_rows`` adds both rows as structs.
    """
    if on_duplicate not in ("error", "first", "last", "trust"):
        raise ValueError("on_duplicate must be 'error', 'first', 'last' or 'trust'")
    if on_duplicate in ("first", "last") and not order_by:
        raise ValueError("keeping one of several rows needs order_by")
    keys = list(keys)
    compare = [c for c in left.columns if c not in keys] if compare is None else list(compare)
    every = [*keys, *compare]
    left, right = nan_to_null(_with_columns(left, every, right)), nan_to_null(_with_columns(right, every, left))
    lt = {f.name: f.dataType for f in left.schema.fields}
    rt = {f.name: f.dataType for f in right.schema.fields}
    shared = [_shared_key(F.col(k), lt[k], F.col(k), rt[k]) for k in keys]
    order = [c for c in order_by or () if on_duplicate in ("first", "last")]

    def side(df: DataFrame, name: str, other: str, position: int) -> DataFrame:
        kept = df.columns if with_rows else every
        row = F.struct(*[F.col(c).alias(f"o_{i}") for i, c in enumerate(order)], F.struct(*kept).alias("row"))
        return df.select(*[s[position].alias(f"k_{i}") for i, s in enumerate(shared)], row.alias(name))

    stacked = side(left, "l", "r", 0).unionByName(side(right, "r", "l", 1), allowMissingColumns=True)
    one = {"first": F.min, "last": F.max}.get(on_duplicate, lambda c: F.first(c, ignorenulls=True))
    grouped = stacked.groupBy(*[f"k_{i}" for i in range(len(keys))]).agg(
        F.count("l").alias("n_left"), F.count("r").alias("n_right"), one("l").alias("l"), one("r").alias("r"))
    if on_duplicate == "error":
        grouped = cut_lineage(grouped, "diff")
        example = grouped.where("n_left > 1 or n_right > 1").take(1)
        if example:
            where = "left" if example[0]["n_left"] > 1 else "right"
            key = {k: example[0][f"k_{i}"] for i, k in enumerate(keys)}
            raise ValueError(f"{where}: key {keys} is not unique, e.g. {key}")
    value = lambda s, c: F.col(f"{s}.row")[c]
    differs = [
        F.when(~same_value(value("l", c), lt[c], value("r", c), rt[c]),
               F.struct(F.lit(c).alias("field"), value("l", c).cast("string").alias("left"), value("r", c).cast("string").alias("right")))
        for c in compare]
    none = F.array().cast("array<struct<field:string,left:string,right:string>>")
    both = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    differing = F.when(both, F.array_compact(F.array(*differs))).otherwise(none) if differs else none
    bucket = (F.when(F.col("n_right") == 0, "only_left").when(F.col("n_left") == 0, "only_right")
              .when(F.size("differing") > 0, "mismatch").otherwise("match"))
    rows = [F.col("l.row").alias("left_row"), F.col("r.row").alias("right_row")] if with_rows else []
    return grouped.withColumn("differing", differing).select(
        *[F.col(f"k_{i}").alias(k) for i, k in enumerate(keys)], bucket.alias("bucket"), "differing", *rows)


def diff_stats(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Six counters and the pass flag over a diff; counters count keys."""
    n = {b: F.count_if(F.col("bucket") == b) for b in BUCKETS}
    bad = n["only_left"] + n["only_right"] + n["mismatch"]
    return result.groupBy(*by).agg(
        (n["match"] + n["mismatch"] + n["only_left"]).alias("rows_left"),
        (n["match"] + n["mismatch"] + n["only_right"]).alias("rows_right"),
        n["match"].alias("rows_matching"), n["only_left"].alias("rows_only_left"),
        n["only_right"].alias("rows_only_right"), n["mismatch"].alias("rows_mismatch"),
        (bad == 0).alias("matches"))


def in_key_order(result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report order: by the text form of the key parts."""
    return result.orderBy(*[F.col(k).cast("string").asc_nulls_first() for k in keys])


def ordered_diff(left: DataFrame, right: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                 ignore: Sequence[str] = ()) -> DataFrame:
    """Row i against row i, globally or within each key; the result is a diff on (keys, position).

    Both sides must have the same columns but for ``ignore``. Where ``order`` leaves ties, rows that both sides
    hold come first, then the others by value: one edited row among equals of the order is one mismatch.
    """
    gaps = (set(left.columns) ^ set(right.columns)) - set(ignore)
    if gaps:
        raise ValueError(f"columns on one side only: {sorted(gaps)}")
    columns = [c for c in left.columns if c in right.columns and (c not in ignore or c in keys or c in order)]
    compare = [c for c in columns if c not in keys and c not in ignore]
    left, right = nan_to_null(left.select(*columns)), nan_to_null(right.select(*columns))
    lt, rt = ({f.name: f.dataType for f in d.schema.fields} for d in (left, right))
    shared = [_shared_key(F.col(c), lt[c], F.col(c), rt[c]) for c in columns]

    def side(df: DataFrame, name: str, position: int) -> DataFrame:
        return df.select(*[s[position].alias(f"k_{i}") for i, s in enumerate(shared)], F.struct(*columns).alias(name))

    # equal rows are counted per side, so a row's copies on both sides pair off
    counted = cut_lineage(
        side(left, "l", 0).unionByName(side(right, "r", 1), allowMissingColumns=True).groupBy(*[f"k_{i}" for i in range(len(columns))])
        .agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.first("l", ignorenulls=True).alias("l"), F.first("r", ignorenulls=True).alias("r")), "ordered")

    def placed(name: str, n: str) -> DataFrame:
        rows = counted.where(F.col(n) > 0).select(
            F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))).alias("__copy"), F.least("n_left", "n_right").alias("__common"), f"{name}.*")
        by = [*nulls_first(*order), (F.col("__copy") > F.col("__common")).asc(), *nulls_first(*columns, "__copy")]
        out = with_ordinal(rows, keys, by, "position") if keys else with_position(rows, by)
        return out.drop("__copy", "__common")

    return diff(placed("l", "n_left"), placed("r", "n_right"), [*keys, "position"], compare, on_duplicate="trust")


def schema_diff(left: DataFrame, right: DataFrame, known_gaps: Sequence[str] = ()) -> DataFrame:
    """(column, side, left_type, right_type) of columns on one side only or of different type.

    Metadata only: no data is read.
    """
    lt = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    rt = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    rows = []
    for c in sorted(set(lt) | set(rt)):
        if c in known_gaps or lt.get(c) == rt.get(c):
            continue
        side = "only_left" if c not in rt else "only_right" if c not in lt else "type"
        rows.append((c, side, lt.get(c), rt.get(c)))
    return left.sparkSession.createDataFrame(rows, "column string, side string, left_type string, right_type string")


def count_diff(left: Mapping[str, DataFrame] | DataFrame, right: Mapping[str, DataFrame] | DataFrame) -> DataFrame:
    """(table, left_rows, right_rows, bucket) for two catalogs or two count tables; names are case-sensitive."""
    l = (left if isinstance(left, DataFrame) else table_counts(left)).select("table", F.col("rows").alias("left_rows"))
    r = (right if isinstance(right, DataFrame) else table_counts(right)).select("table", F.col("rows").alias("right_rows"))
    bucket = (F.when(F.col("right_rows").isNull(), "only_left").when(F.col("left_rows").isNull(), "only_right")
              .when(F.col("left_rows") == F.col("right_rows"), "match").otherwise("mismatch"))
    return l.join(r, "table", "full_outer").withColumn("bucket", bucket).orderBy("table")


def key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of both sides with ``side`` = only_left, only_right or both."""
    stacked = (left.select(*keys, F.lit(1).alias("__s")).union(right.select(*keys, F.lit(2).alias("__s"))))
    side = F.bit_or("__s")
    return (stacked.groupBy(*keys).agg(side.alias("__s"))
            .withColumn("side", F.when(F.col("__s") == 1, "only_left").when(F.col("__s") == 2, "only_right").otherwise("both"))
            .drop("__s"))


def missing_keys(part: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``part`` that ``whole`` lacks (NULL equals NULL); empty means ``part`` is contained."""
    return key_sets(part, whole, keys).where("side = 'only_left'").drop("side")


def expected_empty_guard(stats: DataFrame, allowed: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases where both sides are empty without being listed as expected-empty."""
    return stats.where("rows_left = 0 and rows_right = 0").join(allowed.select(case), case, "left_anti")


def documented_divergence(result: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that break "only-left keys are exactly the documented ones, all else matches"."""
    found = result.where("bucket <> 'match'").select(*keys, F.col("bucket").alias("__b"))
    stacked = found.unionByName(expected.select(*keys, F.lit("documented").alias("__b")))
    has = lambda b: F.bool_or(F.col("__b") == b)
    sides = stacked.groupBy(*keys).agg(
        has("only_left").alias("__left"), has("documented").alias("__doc"),
        F.max(F.when(F.col("__b").isin("only_right", "mismatch"), F.col("__b"))).alias("__other"))
    problems = F.array_compact(F.array(
        F.col("__other"), F.when(F.col("__left") & ~F.col("__doc"), "undocumented").when(~F.col("__left") & F.col("__doc"), "not observed")))
    return sides.select(*keys, F.explode(problems).alias("problem"))


def containment(variants: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """For each ordered pair of variants: size of the first, overlap, share of the first found in the second.

    Every key is reduced to bit masks of the variants that hold it, and masks are
    counted; no pairs of rows are formed. Any number of variants will do.
    """
    names = list(variants)
    spark = next(iter(variants.values())).sparkSession
    words = range(-(-len(names) // _MASK_BITS))      # as many masks as the variants need
    mask = lambda w: f"__m{w}"
    tagged = None
    for i, n in enumerate(names):
        part = variants[n].select(*keys, *[F.lit(1 << i % _MASK_BITS if i // _MASK_BITS == w else 0).cast("bigint").alias(mask(w)) for w in words])
        tagged = part if tagged is None else tagged.unionByName(part)
    masks = (tagged.groupBy(*keys).agg(*[F.bit_or(mask(w)).alias(mask(w)) for w in words])
             .groupBy(*map(mask, words)).agg(F.count(F.lit(1)).alias("__n")))
    held = F.array_compact(F.array(*[F.when(F.getbit(mask(i // _MASK_BITS), F.lit(i % _MASK_BITS)) == 1, F.lit(i)) for i in range(len(names))]))
    members = masks.withColumn("__held", held)
    pairs = members.select(F.explode("__held").alias("a"), "__n", "__held").select("a", "__n", F.explode("__held").alias("b"))
    overlap = pairs.groupBy("a", "b").agg(F.sum("__n").alias("overlap"))
    label = F.array(*[F.lit(n) for n in names])
    every = spark.createDataFrame([(i, j) for i in range(len(names)) for j in range(len(names))], "a int, b int")
    sizes = overlap.where("a = b").select("a", F.col("overlap").alias("size"))
    return (every.join(overlap, ["a", "b"], "left").join(sizes, "a", "left")
            .select(F.get(label, F.col("a")).alias("variant"), F.get(label, F.col("b")).alias("in_variant"),
                    F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("overlap", F.lit(0)).alias("overlap"),
                    (F.coalesce("overlap", F.lit(0)) / F.col("size")).alias("share")))


def case_verdicts(left: DataFrame, right: DataFrame, cases: DataFrame, keys: Sequence[str],
                  compare: Sequence[str] | None = None, on_duplicate: str = "error",
                  order_by: Sequence[str] | None = None) -> DataFrame:
    """Many cases in one diff: both sides carry ``case_id``; one verdict per case.

    ``cases`` is (case_id, category, expected): "pass", "xfail", "skip" or "empty".
    A case without rows on both sides is "vacuous" unless it is expected to be empty.
    """
    stats = diff_stats(diff(left, right, ["case_id", *keys], compare, on_duplicate, order_by), by=["case_id"])
    zero = F.coalesce(F.col("rows_left") + F.col("rows_right"), F.lit(0)) == 0
    good = F.coalesce("matches", F.lit(True))
    verdict = (F.when(F.col("expected") == "skip", "skip")
               .when(zero, F.when(F.col("expected") == "empty", "pass").otherwise("vacuous"))
               .when(F.col("expected") == "xfail", F.when(good, "xpass").otherwise("xfail"))
               .when(good & (F.col("expected") != "empty"), "pass").otherwise("fail"))
    return (cases.join(stats, "case_id", "left").fillna(0, [c for c in stats.columns if c.startswith("rows_")])
            .withColumn("matches", good).withColumn("verdict", verdict))
