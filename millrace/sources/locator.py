"""URLs to locations: scheme, path, options, format, compression and table name."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from urllib.parse import unquote, unquote_plus

FILE_SCHEMES = {"", "file", "s3", "s3a", "gs", "hdfs", "viewfs", "abfss"}
#: Schemes that only say which format a local path has.
FORMAT_SCHEMES = {"csv": "csv", "json": "json", "xml": "xml", "parquet": "parquet", "text": "text", "log": "text"}
RDBMS_SCHEMES = {"mysql", "maria", "mariadb", "postgres", "postgresql", "sqlite", "sqlite3"}
#: Parts of a path that tell the format; the first that occurs counts.
EXTENSIONS = ((".csv", "csv"), (".tsv", "csv"), (".json", "json"), (".xml", "xml"), (".parquet", "parquet"), (".txt", "text"), (".text", "text"), (".log", "text"))
COMPRESSIONS = ((".gz", "gz"), (".zip", "zip"), (".snappy", "snappy"), (".sz", "snappy"))

DEFAULTS = {
    "csv.hasHeader": "true", "csv.sep": ",", "json.objectOnEachLine": "true", "json.rootNode": "", "xml.objectOnEachLine": "true", "xml.elementName": "element",
    "parquet.objectOnEachLine": "false", "std.type": "json", "db.query": "",
}


class SourceError(ValueError):
    """A URL or format that cannot be read or written."""


@dataclass
class Location:
    scheme: str
    path: str
    alias: str = ""
    options: dict[str, str] = field(default_factory=dict)
    raw: str = ""

    @property
    def format(self) -> str:
        if "format" in self.options:
            return self.options["format"]
        if self.scheme in FORMAT_SCHEMES:
            return FORMAT_SCHEMES[self.scheme]
        low = self.path.lower()
        return next((fmt for ext, fmt in EXTENSIONS if ext in low), "json")

    @property
    def compression(self) -> str | None:
        return next((c for ext, c in COMPRESSIONS if self.path.lower().endswith(ext)), None)

    @property
    def name(self) -> str:
        """The alias, or the base name up to its first dot."""
        return self.alias or os.path.basename(self.path.rstrip("/")).split(".")[0]

    @property
    def is_glob(self) -> bool:
        return "*" in self.path

    @property
    def hadoop_path(self) -> str:
        """The path as Spark takes it."""
        if self.scheme == "s3":
            return f"s3a://{self.path}"
        if self.scheme in FORMAT_SCHEMES or self.scheme in ("", "file"):
            p = self.path if self.path.startswith("/") else os.path.abspath(self.path)
            return f"file://{p}" if self.scheme == "file" else p
        return f"{self.scheme}://{self.path}"

    def option(self, key: str, config: dict[str, str] | None = None) -> str:
        """From the URL, then the configuration, then the default."""
        return self.options.get(key, (config or {}).get(key, DEFAULTS.get(key, "")))

    def flag(self, key: str, config: dict[str, str] | None = None) -> bool:
        return self.option(key, config).strip().lower() in ("true", "1", "t", "yes")


def parse(url: str) -> Location:
    """Split ``scheme://path?key=value;key=value#alias``; every part but the path is optional."""
    rest, _, alias = url.partition("#")
    rest, _, query = rest.partition("?")
    scheme, sep, path = rest.partition("://")
    if not sep:
        scheme, path = ("", rest)
        head, colon, tail = rest.partition(":")
        if colon and head.lower() in RDBMS_SCHEMES:
            scheme, path = head, tail
    # a separator is followed by a key, so a value may be one
    pairs = [p.partition("=") for p in re.split(r"[&;](?=[\w.]+=)", query) if p]
    options = {unquote_plus(k): unquote_plus(v) for k, _, v in pairs}
    return Location(scheme.lower(), unquote(path) if scheme in ("", "file") else path, alias, options, url)
