"""Readers and writers of file formats on any file system Spark reaches."""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import normalised
from ..operators.frame import Frame, row_index
from ..session import shared_dir, ship
from .locator import Location, SourceError


def _sep(location: Location, config) -> str:
    sep = location.option("csv.sep", config)
    sep = "\t" if sep in ("\\t", "tab") else sep
    if len(sep) != 1:
        raise SourceError(f"the separator must be one character: {sep!r}")
    return sep


def _names(spark: SparkSession, path: str) -> list:
    """Files of a path, not below folders, sorted; hidden ones left out."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    if not found:
        raise FileNotFoundError(path)
    out = []
    for status in found:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [s.getPath().toString() for s in inner if not s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
    return sorted(out)


# ---------------------------------------------------------------- readers
def read_csv(spark: SparkSession, paths: list[str], location: Location, config) -> DataFrame:
    """All columns are strings, by position under the first file's names; an empty cell is the empty string; a ragged row is an error.

    ``csv.lines`` says that no cell holds a line break, so that a file is read by many tasks.
    """
    header = location.flag("csv.hasHeader", config)
    reader = spark.read.options(header=header, sep=_sep(location, config), quote='"', escape='"', multiLine=not location.flag("csv.lines", config), mode="FAILFAST")
    df = reader.csv(paths[0])
    if len(paths) > 1:
        df = reader.schema(df.schema).csv(paths)
    if not header:
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def _json_type(kind: T.DataType) -> T.DataType:
    """One level of types: numbers are doubles, nested values their JSON text."""
    if isinstance(kind, T.NumericType):
        return T.DoubleType()
    return T.BooleanType() if isinstance(kind, T.BooleanType) else T.StringType()


def _flat(inferred: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, _json_type(f.dataType)) for f in sorted(inferred.fields, key=lambda f: f.name) if f.name != "_corrupt_record"])


def _strings(df: DataFrame):
    """A one-column frame as a JVM dataset of strings, which the JSON reader takes."""
    return getattr(df._jdf, "as")(df.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())


def json_documents(df: DataFrame, column: str = "value") -> DataFrame:
    """Rows of JSON objects (or arrays of them) held as text, one level typed."""
    spark = df.sparkSession
    text = df.select(F.col(column).alias("value")).where(F.trim(column) != "")
    reader = spark._jsparkSession.read().option("mode", "FAILFAST")
    inferred = T._parse_datatype_json_string(reader.json(_strings(text)).schema().json())
    flat = _flat(inferred)
    typed = spark._jsparkSession.read().option("mode", "FAILFAST").schema(spark._jsparkSession.parseDataType(flat.json()))
    return DataFrame(typed.json(_strings(text)), spark)


def read_json(spark: SparkSession, paths: list[str], location: Location, config) -> DataFrame:
    """Lines of objects or arrays of objects, or whole files; ``json.rootNode`` descends first."""
    lines, root = location.flag("json.objectOnEachLine", config), location.option("json.rootNode", config)
    if root:
        text = spark.read.text(paths, wholetext=not lines)
        steps = root.split(".")
        node = text.select(F.get_json_object("value", "$." + ".".join(steps)).alias("value"))
        items = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
        return json_documents(node.select(F.explode(items).alias("value")).where("value is not null"))
    reader = spark.read.options(multiLine=not lines, mode="FAILFAST")
    return reader.schema(_flat(reader.json(paths).schema)).json(paths)


def read_xml(spark: SparkSession, paths: list[str], location: Location, config) -> DataFrame:
    """Rows are elements; attributes have ``_`` before their names; all columns are strings, in order of name."""
    tag = location.option("xml.elementName", config) or "element"
    options = dict(rowTag=tag, inferSchema="false", attributePrefix="_", mode="FAILFAST", ignoreSurroundingSpaces="true")
    if location.flag("xml.objectOnEachLine", config):
        # elements that a line holds whole; what else lines hold is passed over
        name = re.escape(tag)
        element = rf"(?s)(<{name}(?:\s[^>]*)?/>|<{name}(?:\s[^>]*)?>.*?</{name}\s*>)"
        found = spark.read.text(paths).select(F.explode(F.regexp_extract_all("value", F.lit(element))).alias("value"))
        reader = spark._jsparkSession.read()
        for k, v in options.items():
            reader = reader.option(k, v)
        df = DataFrame(reader.xml(_strings(found)), spark)
    else:
        df = spark.read.format("xml").options(**options).load(",".join(paths) if len(paths) == 1 else paths)
    flat = normalised(df)
    return flat.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(flat.columns)])


def read_parquet(spark: SparkSession, paths: list[str], location: Location, config) -> DataFrame:
    """Columns by position under the first file's names; files of one schema, by their footers, are one scan."""
    alike: dict[str, list[str]] = {}
    for p in paths:
        alike.setdefault(_footer(spark, p) if len(paths) > 1 else "", []).append(p)
    scans = [normalised(spark.read.parquet(*group)) for group in alike.values()]
    if len(scans) == 1:
        return scans[0]
    return Frame.merge(*[Frame(f) for f in scans]).df


def _footer(spark: SparkSession, path: str) -> str:
    """A Parquet file's schema, without its name."""
    jvm = spark._jvm
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        return reader.getFooter().getFileMetaData().getSchema().toString().partition("{")[2]
    finally:
        reader.close()


def read_text(spark: SparkSession, paths: list[str], location: Location, config) -> DataFrame:
    """text, rowNumber_ (from 1, in file order)."""
    lines = row_index(spark.read.text(paths), "_i")
    return lines.select(F.col("value").alias("text"), (F.col("_i") + 1).alias("rowNumber_"))


READERS = {"csv": read_csv, "json": read_json, "xml": read_xml, "parquet": read_parquet, "text": read_text}


def _staging(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/millrace-sources/{uuid.uuid4().hex}"


def stage_texts(entries: DataFrame) -> list[str]:
    """Write (name, text) rows as one text file each, in the shared folder; paths in order of name."""
    spark = entries.sparkSession
    path = _staging(spark)
    # a folder for each entry, whose one row is the whole file
    entries.select(F.sha2("name", 256).alias("entry"), "name", "text").select("entry", "text").write.partitionBy("entry").text(path)
    names = [(r["name"], r["entry"]) for r in entries.select("name", F.sha2("name", 256).alias("entry")).distinct().orderBy("name").toLocalIterator()]
    return [f"{path}/entry={e}" for _, e in names]


def unpack(spark: SparkSession, paths: list[str], kind: str) -> list[str]:
    """Zip entries and framed snappy files, decoded by the executors and staged as text files."""

    def decode(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                if kind == "zip":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(f"{path}!{i:06d}!{n}", z.read(n).decode("utf-8-sig")) for i, n in enumerate(z.namelist()) if not n.endswith("/")]
                else:
                    rows.append((path, unframed(content).decode("utf-8-sig")))
            yield pd.DataFrame(rows, columns=["name", "text"])

    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return stage_texts(files.mapInPandas(decode, "name string, text string"))


def unframed(data: bytes) -> bytes:
    """Decode the framed snappy format."""
    import pyarrow as pa

    codec, out, i = pa.Codec("snappy"), [], 0
    while i + 4 <= len(data):
        kind, size = data[i], int.from_bytes(data[i + 1 : i + 4], "little")
        body = data[i + 4 : i + 4 + size]
        if kind == 0:
            length, shift = 0, 0
            for b in body[4:]:
                length |= (b & 0x7F) << shift
                shift += 7
                if not b & 0x80:
                    break
            out.append(codec.decompress(body[4:], length, asbytes=True))
        elif kind == 1:
            out.append(body[4:])
        elif 2 <= kind <= 0x7F:
            raise SourceError("unknown snappy chunk")
        i += 4 + size
    return b"".join(out)


def read_files(spark: SparkSession, location: Location, config=None) -> Frame:
    """A file, every file of a folder, or those of a glob (which needs an alias), one after another."""
    config = dict(config or {})
    if location.is_glob and not location.alias:
        raise SourceError("a file pattern needs an alias: pattern#name")
    if location.scheme in ("s3", "s3a"):
        _s3_options(spark, location.options)
    paths = _names(spark, location.hadoop_path)
    if not paths:
        raise SourceError(f"no files in {location.path}")
    read = READERS.get(location.format, read_text)
    first = Location(location.scheme, paths[0], location.alias, location.options)
    kind = location.compression or first.compression
    if location.format == "json" and "format" not in location.options and not any(e in location.path.lower() for e in (".json",)):
        # of a folder, the files tell the format
        read = READERS.get(first.format, read_text)
    if kind in ("zip", "snappy") and read is not read_parquet:
        paths = unpack(spark, paths, kind)
    return Frame(read(spark, paths, location, config), location.name)


def _s3_options(spark: SparkSession, options: dict[str, str]) -> None:
    """Credentials and region of a URL, set on the session's file system and never logged."""
    conf = spark._jsc.hadoopConfiguration()
    names = {"AWS_ACCESS_KEY_ID": "fs.s3a.access.key", "AWS_SECRET_ACCESS_KEY": "fs.s3a.secret.key", "AWS_SESSION_TOKEN": "fs.s3a.session.token", "AWS_REGION": "fs.s3a.endpoint.region"}
    for key, value in options.items():
        if key.upper() in names:
            conf.set(names[key.upper()], value)


# ---------------------------------------------------------------- writers
def _number(c: Column) -> Column:
    """Doubles that are whole print without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def json_lines(df: DataFrame) -> DataFrame:
    """value: each row as a JSON object, keys sorted, nulls kept."""
    parts = []
    for name in sorted(df.columns):
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            text = _number(c)
        else:
            text = F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
        key = F.regexp_extract(F.to_json(F.array(F.lit(name))), r"(?s)^\[(.*)\]$", 1)
        parts.append(F.concat(key, F.lit(":"), F.when(c.isNull(), F.lit("null")).otherwise(text)))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def xml_lines(df: DataFrame, tag: str) -> DataFrame:
    """value: each row as an element; columns named ``_x`` are attributes."""

    def escaped(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def text(name: str) -> Column:
        c = F.col(f"`{name}`")
        return escaped(_number(c) if isinstance(df.schema[name].dataType, T.DoubleType) else c.cast("string"))

    attributes = [F.concat(F.lit(f' {n[1:]}="'), F.coalesce(text(n), F.lit("")), F.lit('"')) for n in df.columns if n.startswith("_")]
    children = [F.concat(F.lit(f"<{n}>"), F.coalesce(text(n), F.lit("")), F.lit(f"</{n}>")) for n in df.columns if not n.startswith("_")]
    return df.select(F.concat(F.lit(f"<{tag}"), *attributes, F.lit(">"), *children, F.lit(f"</{tag}>")).alias("value"))


def _unique(df: DataFrame) -> DataFrame:
    """Repeated column names get a number, as files cannot hold them."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c.lower()] = seen.get(c.lower(), 0) + 1
        names.append(c if seen[c.lower()] == 1 else f"{c}_{seen[c.lower()]}")
    return df.toDF(*names) if names != df.columns else df


def write_files(frame: Frame, location: Location, config=None) -> None:
    """Write a frame; a path that ends with ``/`` is a folder of parts, written in parallel, else one file."""
    df, config = _unique(frame.df), dict(config or {})
    spark, fmt = df.sparkSession, location.format
    whole_json = fmt == "json" and not location.flag("json.objectOnEachLine", config)
    folder = location.path.endswith("/")
    out = df if folder else df.coalesce(1)
    target = location.hadoop_path if folder else _staging(spark)
    if fmt == "csv":
        flat = out.select(*[F.col(f"`{c}`").cast("string").alias(c) if not isinstance(df.schema[c].dataType, T.DoubleType) else _number(F.col(f"`{c}`")).alias(c) for c in df.columns])
        flat.write.mode("overwrite").options(header=location.flag("csv.hasHeader", config), sep=_sep(location, config), quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(target)
    elif fmt == "json":
        json_lines(out).write.mode("overwrite").text(target)
    elif fmt == "xml":
        xml_lines(out, location.option("xml.elementName", config) or "element").write.mode("overwrite").text(target)
    elif fmt == "parquet":
        out.write.mode("overwrite").option("compression", "none").parquet(target)
    else:
        raise SourceError(f"cannot write {fmt}")
    if not folder:
        wrap = ("[", "]", ",") if whole_json else ("<root>\n", "</root>\n", "") if fmt == "xml" and not location.flag("xml.objectOnEachLine", config) else None
        _publish(spark, target, location.hadoop_path, wrap)


def _publish(spark: SparkSession, parts: str, target: str, wrap: tuple[str, str, str] | None) -> None:
    """Move the one part of a folder to its name; or copy its lines between a head and a tail."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    part = _names(spark, parts)
    src, dst = path(parts).getFileSystem(conf), path(target).getFileSystem(conf)
    dst.delete(path(target), False)
    if wrap is None:
        if part:
            jvm.org.apache.hadoop.fs.FileUtil.copy(src, path(part[0]), dst, path(target), True, conf)
        else:
            dst.create(path(target)).close()
    else:
        head, tail, between = wrap
        stream = dst.create(path(target))
        stream.write(bytearray(head, "utf-8"))
        first = True
        for row in spark.read.text(part).toLocalIterator() if part else ():
            line = row[0] if between else row[0] + "\n"
            stream.write(bytearray(line if first or not between else between + line, "utf-8"))
            first = False
        stream.write(bytearray(tail, "utf-8"))
        stream.close()
    src.delete(path(parts), True)


def framed(data: bytes) -> bytes:
    """Encode in the framed snappy format, uncompressed chunks of at most 65,536 bytes; checksums are left at zero, which readers here ignore."""
    chunks = [data[i : i + 65_532] for i in range(0, len(data), 65_532)]
    return b"\xff\x06\x00\x00sNaPpY" + b"".join(b"\x01" + (len(c) + 4).to_bytes(3, "little") + bytes(4) + c for c in chunks)


def packed(spark: SparkSession, frame: Frame, target: str, kind: str) -> None:
    """Write a small frame as one file in a form the sinks do not write: gz, zip (two entries), snappy, a JSON root node, or its second column as text."""
    rows = [["" if v is None else str(v) for v in r] for r in frame.df.collect()]
    csv = "".join(",".join(r) + "\n" for r in [frame.df.columns, *rows]).encode()
    if kind == "gz":
        data = gzip.compress(csv)
    elif kind == "zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name in ("a.csv", "b.csv"):
                z.writestr(name, csv)
        data = out.getvalue()
    elif kind == "snappy":
        data = framed(csv)
    elif kind == "root":
        data = ('{"rows":[' + ",".join(r[0] for r in json_lines(frame.df).collect()) + "]}").encode()
    else:
        data = "".join(r[1] + "\n" for r in rows).encode()
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(data))
    stream.close()
