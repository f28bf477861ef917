"""MySQL column types as Spark types."""
from __future__ import annotations

import re

from pyspark.sql import types as T

# fixed values: type words of the dump and what they become
_BY_WORD: dict[str, T.DataType] = {
    "tinyint": T.ShortType(),
    "smallint": T.ShortType(),
    "mediumint": T.IntegerType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "float": T.DoubleType(),
    "real": T.DoubleType(),
    "char": T.StringType(),
    "varchar": T.StringType(),
    "tinytext": T.StringType(),
    "text": T.StringType(),
    "mediumtext": T.StringType(),
    "longtext": T.StringType(),
    "enum": T.StringType(),
    "set": T.StringType(),
    "json": T.StringType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampNTZType(),
    "time": T.StringType(),
    "year": T.ShortType(),
    "binary": T.BinaryType(),
    "varbinary": T.BinaryType(),
    "tinyblob": T.BinaryType(),
    "blob": T.BinaryType(),
    "mediumblob": T.BinaryType(),
    "longblob": T.BinaryType(),
}
# the next wider type where a column is unsigned
_UNSIGNED = {"smallint": T.IntegerType(), "int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0)}


def spark_type(mysql_type: str) -> T.DataType:
    """Spark type of a MySQL type text such as ``varchar(255)``; nothing is narrowed.

    The simple name of a Spark type (what this function's result prints as) maps to
    itself, so applying it twice changes nothing.
    """
    m = re.match(r"\s*([a-z_]+)\s*(?:\(\s*([^)]*)\))?\s*(.*)", mysql_type, re.I)
    if m is None:
        raise ValueError(f"not a column type: {mysql_type!r}")
    word, args, rest = m.group(1).lower(), m.group(2), m.group(3).lower()
    if word in ("decimal", "numeric"):
        p, _, s = (args or "10,0").partition(",")
        return T.DecimalType(min(int(p), 38), int(s or 0))
    if word == "bit":
        return T.BooleanType() if (args or "1").strip() == "1" else T.BinaryType()
    if "unsigned" in rest and word in _UNSIGNED:
        return _UNSIGNED[word]
    if word in _BY_WORD:
        return _BY_WORD[word]
    same = {"string": T.StringType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}
    if word in same:
        return same[word]
    raise ValueError(f"unknown column type: {mysql_type!r}")


def table_schema(columns: list[tuple[str, str]]) -> T.StructType:
    """Every column is nullable: declared keys and NOT NULL are documentation only."""
    return T.StructType([T.StructField(n, spark_type(t), True) for n, t in columns])
