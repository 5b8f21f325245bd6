"""Dispatch of URLs to sources; own sources can be added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..operators.frame import Frame
from . import files, rdbms, std
from .locator import FILE_SCHEMES, FORMAT_SCHEMES, RDBMS_SCHEMES, Location, SourceError, parse

Reader = Callable[[SparkSession, Location, dict], Frame]
Writer = Callable[[Frame, Location, dict], None]


def _no_write(frame: Frame, location: Location, config: dict) -> None:
    raise SourceError(f"{location.scheme} cannot be written")


_SOURCES: dict[str, tuple[Reader, Writer]] = {
    **{s: (files.read_files, files.write_files) for s in FILE_SCHEMES | set(FORMAT_SCHEMES)},
    **{s: (rdbms.read_rdbms, _no_write) for s in RDBMS_SCHEMES},
}


def register_source(scheme: str, read: Reader, write: Writer = _no_write) -> None:
    """Add a source for a URL scheme, or replace one."""
    _SOURCES[scheme.lower()] = (read, write)


def register_data_source(spark: SparkSession, source: type, scheme: str | None = None) -> None:
    """Add a Python data source class (``pyspark.sql.datasource.DataSource``) and a scheme that reads it."""
    spark.dataSource.register(source)
    name = source.name()

    def read(s: SparkSession, location: Location, config: dict) -> Frame:
        return Frame(s.read.format(name).options(**location.options).load(location.path), location.name)

    register_source(scheme or name, read)


def resolve(url: str) -> tuple[Location, Reader, Writer]:
    location = parse(url)
    if location.scheme not in _SOURCES:
        raise SourceError(f"no source for {location.scheme}://")
    return location, *_SOURCES[location.scheme]


def read_sources(spark: SparkSession, config=None, *urls: str) -> list[Frame]:
    """A frame for each URL; ``-`` is standard input. Reads are lazy, so sources load in parallel with the query."""
    out = []
    for url in urls:
        if url == "-":
            out.append(std.read_stdin(spark, config))
        else:
            location, read, _ = resolve(url)
            out.append(read(spark, location, dict(config or {})))
    return out


def write_source(frame: Frame, config=None, url: str = "-") -> None:
    if url == "-":
        std.write_stdout(frame, config)
    else:
        location, _, write = resolve(url)
        write(frame, location, dict(config or {}))
