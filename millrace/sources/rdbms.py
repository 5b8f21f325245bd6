"""Relational databases: the query runs there, the result is a table here."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..functions.types import SPARK_TYPES, FormatError, get_format, normalised
from ..operators.frame import Frame
from .locator import Location, SourceError

_JDBC = {"mysql": "mysql", "maria": "mysql", "mariadb": "mysql", "postgres": "postgresql", "postgresql": "postgresql"}


def read_rdbms(spark: SparkSession, location: Location, config=None) -> Frame:
    query = location.option("db.query", config)
    if not query:
        raise SourceError("db.query is needed")
    if location.scheme.startswith("sqlite"):
        return Frame(_sqlite(spark, location.path, query), location.name)
    kind = _JDBC[location.scheme]
    login, _, host = location.path.rpartition("@")
    host = re.sub(r"^tcp\((.*?)\)", r"\1", host)  # a protocol may wrap host and port
    url = f"jdbc:{kind}://{host}" + ("?sslmode=disable" if kind == "postgresql" and "sslmode" not in location.options else "")
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    if login:
        user, _, password = login.partition(":")
        reader = reader.option("user", user).option("password", password)
    # a partitioned read where the caller names a column: partitionColumn, lowerBound, upperBound, numPartitions
    reader = reader.options(**{k: v for k, v in location.options.items() if k not in ("db.query", "format")})
    return Frame(normalised(reader.load()), location.name)


def _sqlite(spark: SparkSession, path: str, query: str):
    """Through the standard library; declared types give formats, else text."""
    path = "/" + path.lstrip("/") if path.startswith("//") else path
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        cursor = db.execute(query)
        names = [d[0] for d in cursor.description]
        declared = {}
        for (table,) in db.execute("select name from sqlite_master where type = 'table'").fetchall():
            for row in db.execute(f'pragma table_info("{table}")').fetchall():
                declared.setdefault(row[1].lower(), row[2])
        rows = cursor.fetchall()
    kinds = []
    for n in names:
        try:
            kinds.append(SPARK_TYPES[get_format(declared.get(n.lower(), "string"))])
        except FormatError:
            kinds.append(T.StringType())

    def cell(v, kind):
        if v is None:
            return None
        if isinstance(kind, T.StringType):
            return v if isinstance(v, str) else str(v)
        if isinstance(kind, T.BooleanType):
            return str(v).lower() in ("1", "true", "t")
        if isinstance(kind, T.LongType):
            return int(v)
        if isinstance(kind, T.TimestampType):
            import datetime

            return datetime.datetime.fromisoformat(str(v))
        return float(v)

    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    return spark.createDataFrame([tuple(cell(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows], schema)
