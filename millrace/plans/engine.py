"""SQL over frames and sources: names become temporary views, the query is rewritten and handed to Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqlfuncs
from ..functions.types import BOOLEAN, DATETIME, DOUBLE, INTEGER, STRING, schema_text
from ..operators.frame import Frame, pair_blocks
from ..session import configure
from .rewrite import rewrite, self_joins, tokenize

_PRAGMA = re.compile(r"\s*pragma\s+table_info\s*\(\s*[\"'`\[]?(.+?)[\"'`\]]?\s*\)\s*;?\s*", re.I)
#: Column types that table_info reports.
DECLARED = {STRING: "text", DATETIME: "text", INTEGER: "integer", DOUBLE: "double", BOOLEAN: "boolean"}


def table_info(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = [(i, n, DECLARED[f], 0, None, 0) for i, (n, f) in enumerate(schema_text(df))]
    return spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")


def _blocked(query: str, tables: Mapping[str, DataFrame]) -> str:
    """The query with its large self-joins dealt out by blocks: their pairs grow with the square of a key's rows, whatever the number of keys."""
    toks = tokenize(query)
    by_name = {name.lower(): df for name, df in tables.items()}
    edits = []
    for join in self_joins(toks, {name: df.columns for name, df in by_name.items()}):
        names = "_pair_left", "_pair_right"
        if sides := pair_blocks(by_name[join.table], join.key, *names):
            views = [f"_pair_{len(edits)}_{side}" for side in ("left", "right")]
            for view, df in zip(views, sides, strict=True):
                df.createOrReplaceTempView(view)
            edits += join.edits(*views, *names)
    out = [t.text for t in toks]
    for start, end, text in sorted(edits, reverse=True):
        out[start:end] = [text]
    return "".join(out)


def run_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame], compat: str | None = None) -> DataFrame:
    """Run a query of the dialect over named tables; the result is lazy, but for a count where a table is joined with itself."""
    configure(spark)
    sqlfuncs.register(spark)
    for name, df in tables.items():
        df.createOrReplaceTempView("`" + name.replace("`", "``") + "`")
    if m := _PRAGMA.fullmatch(query):
        found = {k.lower(): v for k, v in tables.items()}
        if m[1].lower() not in found:
            raise ValueError(f"no table {m[1]}")
        return table_info(spark, found[m[1].lower()])
    known = {n.lower() for n in tables} | {c.lower() for df in tables.values() for c in df.columns}
    return spark.sql(rewrite(_blocked(query, tables), known, compat))


def register_function(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """Make a Python function callable in queries by ``name``; ``returns`` is its Spark type. Arrow-batched; executors get the package."""
    configure(spark)
    spark.udf.register(name, F.udf(f, returns, useArrow=True))


def query_frames(spark: SparkSession, query: str, config: Mapping[str, str] | None = None, *frames: Frame) -> Frame:
    """Run a query over frames, each under its name."""
    config = dict(config or {})
    return Frame(run_sql(spark, query, {f.name: f.df for f in frames}, compat=config.get("engine.compat")), "result")


def query_sources(spark: SparkSession, query: str, config: Mapping[str, str] | None = None, *urls: str) -> Frame:
    """Read every URL as a table and run a query over them."""
    from ..sources.registry import read_sources

    return query_frames(spark, query, config, *read_sources(spark, config, *urls))
