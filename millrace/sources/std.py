"""Standard input and output."""

from __future__ import annotations

import sys
from itertools import chain
from typing import TextIO

from pyspark.sql import SparkSession

from ..operators.frame import Frame
from .files import READERS, json_lines, read_text, stage_texts, xml_lines
from .locator import Location, SourceError

NIL = "<nil>"


def read_stdin(spark: SparkSession, config=None, stream: TextIO | None = None) -> Frame:
    """The table ``stdin``; its format is ``std.type``, JSON by default."""
    config = dict(config or {})
    text = (stream or sys.stdin).read()
    location = Location("std", "stdin", "stdin", {"format": config.get("std.type", "json")})
    paths = stage_texts(spark.createDataFrame([("stdin", text)], "name string, text string"))
    return Frame(READERS.get(location.format, read_text)(spark, paths, location, config), "stdin")


def shown(value) -> str:
    if value is None:
        return NIL
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return str(value)


def write_table(frame: Frame, out: TextIO) -> None:
    """A plain table: one pass for the widths, one that fetches rows a partition at a time and keeps none."""
    names = frame.df.columns
    widths = [len(n) for n in names]
    text = frame.df.toDF(*[f"_{i}" for i in range(len(names))])
    for row in text.toLocalIterator():
        widths = [max(w, len(shown(v))) for w, v in zip(widths, row, strict=True)]
    for row in chain(([n.upper() for n in names], ["-" * w for w in widths]), ([shown(v) for v in row] for row in text.toLocalIterator())):
        out.write("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() + "\n")


def write_stdout(frame: Frame, config=None, out: TextIO | None = None) -> None:
    out, config = out or sys.stdout, dict(config or {})
    kind = config.get("std.type", "table")
    location = Location("std", "stdout", "", {})
    if kind == "table":
        write_table(frame, out)
    elif kind == "csv":
        import csv

        w = csv.writer(out, delimiter="\t" if location.option("csv.sep", config) in ("\\t", "\t") else location.option("csv.sep", config), lineterminator="\n")
        if location.flag("csv.hasHeader", config):
            w.writerow(frame.df.columns)
        names = [f"_{i}" for i in range(len(frame.df.columns))]
        for row in frame.df.toDF(*names).toLocalIterator():
            w.writerow(["" if v is None else shown(v) for v in row])
    elif kind == "json":
        lines = (r[0] for r in json_lines(frame.df).toLocalIterator())
        if location.flag("json.objectOnEachLine", config):
            for line in lines:
                out.write(line + "\n")
        else:
            out.write("[" + ",".join(lines) + "]")
    elif kind == "xml":
        whole = not location.flag("xml.objectOnEachLine", config)
        out.write("<root>\n" * whole)
        for r in xml_lines(frame.df, location.option("xml.elementName", config)).toLocalIterator():
            out.write(r[0] + "\n")
        out.write("</root>\n" * whole)
    else:
        raise SourceError(f"cannot write {kind} to standard output")
