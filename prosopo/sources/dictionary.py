"""The column dictionary: an optional sheet that declares formats, keys and nullability."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# fixed values: the header, the formats and what they become, and the key labels
HEADER = ("RowNum", "DumpTblNm", "DumpFldNm", "AccessTblNm", "AccessFldNm",
          "IndexOnField", "DataFormat", "NULL_allowed", "ForeignKey", "ForeignKeyBaseField")
FORMATS = {"Long": "int", "Integer": "smallint", "Double": "double", "Text": "string", "Memo": "string", "Binary": "binary"}
KEY_LABELS = ("Primary", "Primary Key")
TRUE_TEXT, FALSE_TEXT = ("true", "yes", "y", "1"), ("false", "no", "n", "0")


class DictionaryError(ValueError):
    """The sheet is not laid out as documented."""


def load_dictionary(sheet: DataFrame) -> DataFrame:
    """Normalise and check a dictionary sheet (all columns text, header as ``HEADER``).

    Gives (table, column, format, spark_type, nullable, is_key, foreign_table,
    foreign_column, dump_table, dump_column, position). Rows without table or column
    are spacers. A blank format is NULL: the dump's own type then counts. A blank
    nullable cell means nullable.
    """
    if tuple(sheet.columns[:len(HEADER)]) != HEADER:
        raise DictionaryError(f"unexpected header {sheet.columns}")
    extra = sheet.columns[len(HEADER):]
    clean = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    named = sheet.withColumn("position", F.monotonically_increasing_id()).select(
        clean("AccessTblNm").alias("table"), clean("AccessFldNm").alias("column"),
        F.initcap(clean("DataFormat")).alias("format"),
        F.lower(clean("NULL_allowed")).alias("null_text"),
        F.coalesce(clean("IndexOnField").isin(*KEY_LABELS), F.lit(False)).alias("is_key"),
        clean("ForeignKey").alias("foreign_table"), clean("ForeignKeyBaseField").alias("foreign_column"),
        clean("DumpTblNm").alias("dump_table"), clean("DumpFldNm").alias("dump_column"), "position",
        F.coalesce(*[clean(c) for c in extra], F.lit(None).cast("string")).alias("extra"))
    stray = named.where("extra is not null").take(1)
    if stray:
        raise DictionaryError(f"data beyond the documented columns: {stray[0]['extra']!r}")
    rows = named.where("table is not null and column is not null").drop("extra")
    wrong = rows.where(F.col("format").isNotNull() & ~F.col("format").isin(*FORMATS)).take(1)
    if wrong:
        raise DictionaryError(f"{wrong[0]['table']}.{wrong[0]['column']}: unknown format {wrong[0]['format']!r}")
    unclear = rows.where(F.col("null_text").isNotNull() & ~F.col("null_text").isin(*TRUE_TEXT, *FALSE_TEXT)).take(1)
    if unclear:
        raise DictionaryError(f"{unclear[0]['table']}.{unclear[0]['column']}: not a yes/no cell {unclear[0]['null_text']!r}")
    twice = rows.groupBy("table", "column").count().where("count > 1").take(1)
    if twice:
        raise DictionaryError(f"duplicate column {twice[0]['column']!r} in {twice[0]['table']!r}")
    types = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return rows.select(
        "table", "column", "format", F.try_element_at(types, F.col("format")).alias("spark_type"),
        (F.col("null_text").isNull() | F.col("null_text").isin(*TRUE_TEXT)).alias("nullable"), "is_key",
        "foreign_table", "foreign_column", "dump_table", "dump_column", "position")


def overlay_types(dump_columns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Effective type per dump column: the dictionary's format, else the dump's type."""
    d = dictionary.select("table", "column", "spark_type", "is_key", "nullable")
    return (dump_columns.join(d, ["table", "column"], "left")
            .select("table", "position", "column", F.coalesce("spark_type", "mysql_type").alias("effective_type"),
                    F.coalesce("is_key", F.lit(False)).alias("is_key"), F.coalesce("nullable", F.lit(True)).alias("nullable")))


def constraint_report(df: DataFrame, keys: list[str], not_null: list[str]) -> DataFrame:
    """Violations of declared constraints, which are reported and never enforced:
    (constraint, columns, violations)."""
    parts = []
    if keys:
        parts.append(df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("violations"))
                     .select(F.lit("key").alias("constraint"), F.lit(",".join(keys)).alias("columns"), "violations"))
    if not_null:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
        parts.append(counts.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in not_null]), F.array(*[F.col(f"`{c}`") for c in not_null]))).alias("columns", "violations"))
            .select(F.lit("not null").alias("constraint"), "columns", "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
