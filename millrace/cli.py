"""Command line: ``python -m millrace [flags] <query> [urls or -]``."""

from __future__ import annotations

import argparse
import sys

from .plans.engine import query_sources
from .session import get_session
from .sources.registry import write_source


def _truth(text: str) -> str:
    if text.strip().lower() not in ("true", "false", "1", "0", "t", "f"):
        raise argparse.ArgumentTypeError(f"not a truth value: {text}")
    return "true" if text.strip().lower() in ("true", "1", "t") else "false"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description="Run SQL over files, databases and standard input.")
    add = lambda name, default, kind=str, text="": p.add_argument(f"-{name}", f"--{name}", dest=name, default=default, type=kind, nargs="?" if kind is _truth else None, const="true" if kind is _truth else None, help=text)
    add("input.csv.sep", ",", text="separator of CSV input")
    add("input.csv.hasHeader", "true", _truth, "first line is the header")
    add("input.json.objectOnEachLine", "true", _truth, "a JSON value on each line")
    add("input.json.rootNode", "", text="path of the node that holds the rows")
    add("input.std.type", "json", text="format of standard input")
    add("input.xml.elementName", "element", text="XML element of a row")
    add("input.xml.objectOnEachLine", "true", _truth, "an element on each line")
    add("input.db.query", "", text="query for a database source")
    add("output.std.type", "table", text="format of standard output")
    add("output.csv.sep", ",", text="separator of CSV output")
    add("output.csv.hasHeader", "true", _truth, "write a header")
    add("output.json.objectOnEachLine", "true", _truth, "an object on each line")
    add("output.xml.elementName", "element", text="XML element of a row")
    add("output.xml.objectOnEachLine", "true", _truth, "a row on each line")
    add("output", "-", text="where the result goes")
    add("logger", "error", text="debug, info, warning or error")
    add("engine.storage", "memory", text="accepted; all storages behave alike")
    add("engine.compat", "", text="sqlite: LIKE ignores case")
    p.add_argument("query", nargs="?")
    p.add_argument("urls", nargs="*")
    return p


def configs(args: argparse.Namespace) -> tuple[dict[str, str], dict[str, str]]:
    """Input and output settings, without their prefixes."""
    given = vars(args)
    pick = lambda side: {k[len(side) + 1 :]: v for k, v in given.items() if k.startswith(side + ".")}
    return pick("input") | {"engine.compat": given["engine.compat"]}, pick("output")


def main(argv: list[str] | None = None, spark=None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    # a lone "-" is a URL, not a flag
    args = parser().parse_args(argv)
    if not args.query:
        parser().print_usage(sys.stderr)
        return 1
    levels = {"debug": "DEBUG", "info": "INFO", "warning": "WARN", "error": "ERROR"}
    spark = spark or get_session(master="local[*]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel(levels.get(args.logger, "ERROR"))
    source, sink = configs(args)
    try:
        write_source(query_sources(spark, args.query, source, *args.urls), sink, args.output)
    except Exception as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0
