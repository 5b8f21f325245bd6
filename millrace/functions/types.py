"""The five logical formats, their Spark types, and conversions between them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, DOUBLE, STRING, BOOLEAN, DATETIME = "integer", "double", "string", "boolean", "datetime"

SPARK_TYPES: dict[str, T.DataType] = {INTEGER: T.LongType(), DOUBLE: T.DoubleType(), STRING: T.StringType(), BOOLEAN: T.BooleanType(), DATETIME: T.TimestampType()}

# fixed values: accepted type names of each format
NAMES: dict[str, tuple[str, ...]] = {
    INTEGER: ("integer", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64"),
    DOUBLE: ("double", "float32", "float64"),
    STRING: ("string", "text"),
    BOOLEAN: ("bool", "boolean"),
    DATETIME: ("date", "datetime", "time"),
}


class FormatError(ValueError):
    """An unknown format name, or a schema that does not fit."""


def get_format(name: str) -> str:
    """The format of a type name; names are case-insensitive."""
    for fmt, names in NAMES.items():
        if name.strip().lower() in names:
            return fmt
    raise FormatError(f"unknown format: {name}")


def format_of(kind: T.DataType) -> str:
    """The format that carries a Spark type; what has none is carried as text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DOUBLE
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return STRING


def to_text(c: Column, source: str) -> Column:
    """Text of a value; integral doubles lose their fraction."""
    text = c.cast("string")
    return F.regexp_replace(text, r"\.0$", "") if source == DOUBLE else text


def convert(c: Column, source: str, target: str, strict: bool = True) -> Column:
    """Convert between formats. A bad value raises if ``strict``, else gives null."""
    target, source = get_format(target), get_format(source)
    if source == target:
        return c
    if target == STRING:
        return to_text(c, source)
    if target == DATETIME:
        # only times (and texts that spell one) are times
        return F.try_to_timestamp(c) if source == STRING else F.lit(None).cast("timestamp")
    if source == DATETIME:
        millis = F.unix_millis(c.cast("timestamp"))
        return {INTEGER: millis, DOUBLE: millis.cast("double")}.get(target, F.lit(None).cast("boolean"))
    if target == BOOLEAN and source == INTEGER:
        return c != 0
    if target == BOOLEAN and source == DOUBLE:
        got = F.when(c == 1, True).when(c == 0, False)
    elif source == STRING:
        got = {INTEGER: c.try_cast("double").try_cast("bigint"), DOUBLE: c.try_cast("double"), BOOLEAN: _parse_bool(c)}[target]
    elif source == BOOLEAN:
        return c.cast("int").cast(SPARK_TYPES[target])
    else:
        # double to integer truncates
        return c.cast(SPARK_TYPES[target])
    if not strict:
        return got
    bad = c.isNotNull() & got.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"cannot convert to {target}: "), c.cast("string"))).cast(SPARK_TYPES[target])).otherwise(got)


def _parse_bool(c: Column) -> Column:
    # fixed values: spellings of truth values
    return F.when(c.isin("1", "t", "T", "TRUE", "true", "True"), True).when(c.isin("0", "f", "F", "FALSE", "false", "False"), False)


def normalised(df: DataFrame) -> DataFrame:
    """Every column as the Spark type of its format; nested values as JSON text."""
    out = []
    for f in df.schema.fields:
        c, fmt = F.col(f"`{f.name}`"), format_of(f.dataType)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif f.dataType != SPARK_TYPES[fmt]:
            c = c.cast(SPARK_TYPES[fmt])
        out.append(c.alias(f.name))
    return df.select(*out)


def schema_text(df: DataFrame) -> list[tuple[str, str]]:
    """(name, format) of every column, in order."""
    return [(f.name, format_of(f.dataType)) for f in df.schema.fields]


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    """Equal names, case aside, and formats, by position."""
    return [(n.lower(), f) for n, f in schema_text(a)] == [(n.lower(), f) for n, f in schema_text(b)]


def safe_name(name: str) -> str:
    return re.sub(r"\W", "_", name)
