"""Readers, writers, dispatch and the command line."""

import gzip
import io
import json
import sqlite3
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.cli import main
from millrace.operators.frame import Frame
from millrace.plans.engine import query_frames, query_sources
from millrace.sources import files, std
from millrace.sources.locator import SourceError, parse
from millrace.sources.registry import read_sources, register_data_source, register_source, write_source

CSV = "c1,c2,c3\n1,a,x\n2,b,\n3,\"c,d\",\"q\"\"r\"\n4,d,y\n"


@pytest.fixture
def d(tmp_path):
    return tmp_path


def read(spark, url, **config):
    return read_sources(spark, {k.replace("__", "."): v for k, v in config.items()}, str(url))[0]


def rows(f):
    return [tuple(r) for r in f.df.collect()]


def test_locator():
    loc = parse("s3://bucket/a/b.csv.gz?csv.sep=;&x=1#t")
    assert (loc.scheme, loc.format, loc.compression, loc.name, loc.hadoop_path) == ("s3", "csv", "gz", "t", "s3a://bucket/a/b.csv.gz")
    assert parse("/x/data.v1.json").name == "data" and parse("/x/y.tsv").format == "csv" and parse("/x/y.log").format == "text" and parse("/x/y").format == "json"
    assert parse("sqlite:/tmp/x.db").scheme == "sqlite" and parse("gs://b/x.parquet").hadoop_path == "gs://b/x.parquet" and parse("csv:///a/b").format == "csv" and parse("/a/b?format=xml").format == "xml"
    with pytest.raises(SourceError):
        read_sources(None, {}, "ftp://x/y")


def test_csv(spark, d):
    (d / "t.csv").write_bytes(b"\xef\xbb\xbf" + CSV.encode())
    f = read(spark, d / "t.csv")
    assert f.name == "t" and f.schema() == [("c1", "string"), ("c2", "string"), ("c3", "string")]
    assert rows(f) == [("1", "a", "x"), ("2", "b", ""), ("3", "c,d", 'q"r'), ("4", "d", "y")]
    (d / "n.tsv").write_text("1\t2\n3\t4\n")
    assert rows(read(spark, f"{d}/n.tsv?csv.sep=\\t&csv.hasHeader=false")) == [("1", "2"), ("3", "4")] and read(spark, d / "n.tsv", csv__sep="\\t", csv__hasHeader="false").columns == ["c0", "c1"]
    with pytest.raises(SourceError):
        read(spark, d / "t.csv", csv__sep="^^")
    with pytest.raises(FileNotFoundError):
        read(spark, d / "none.csv")
    (d / "bad.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):  # noqa: B017
        rows(read(spark, d / "bad.csv"))


def test_csv_round_trip(spark, d):
    text = "a\tb\n1\tx y\n2\t\"q\t\"\n3\t\n"
    (d / "t.csv").write_text(text)
    for header in ("true", "false"):
        c = {"csv.sep": "\t", "csv.hasHeader": header}
        write_source(read_sources(spark, c, str(d / "t.csv"))[0], c, str(d / "o.csv"))
        assert (d / "o.csv").read_text() == text


def test_json(spark, d):
    (d / "l.json").write_text('[{"a":1,"b":3.0,"c":"c1"},{"a":2,"c":"c2","b":null}]\n\n{"a":5,"d":"","c":"x\\"y"}\n')
    f = read(spark, d / "l.json")
    assert f.schema() == [("a", "double"), ("b", "double"), ("c", "string"), ("d", "string")]
    assert sorted(rows(f)) == [(1.0, 3.0, "c1", None), (2.0, None, "c2", None), (5.0, None, 'x"y', "")]
    (d / "n.json").write_text('[\n{"a":1,"b":true,"e":[1,2,3],"f":{"k":1},"g":null}\n]')
    g = read(spark, d / "n.json", json__objectOnEachLine="false")
    assert rows(g) == [(1.0, True, "[1,2,3]", '{"k":1}', None)]
    (d / "r.json").write_text('{"x":{"y":[{"a":1},{"a":2}]}}')
    assert sorted(rows(read(spark, d / "r.json", json__rootNode="x.y", json__objectOnEachLine="false"))) == [(1.0,), (2.0,)]


def test_json_round_trip(spark, d):
    line = '{"a":1,"b":1.5,"c":"x\\"y","d":null,"e":true}'
    (d / "t.json").write_text(line + "\n")
    f = read(spark, d / "t.json")
    write_source(f, {}, str(d / "o.json"))
    assert (d / "o.json").read_text() == line + "\n"
    write_source(f, {"json.objectOnEachLine": "false"}, str(d / "p.json"))
    assert (d / "p.json").read_text() == f"[{line}]" and json.loads((d / "p.json").read_text())


def test_xml(spark, d):
    body = '<element a="1"><b>2</b><c>c1</c><d>d1</d></element>\n<element a="3"><b>4</b><c>c2</c><d>d,2</d></element>\n<element a="5"><b></b><c></c><d>d2</d></element>\n'
    for name, text in (("w.xml", f"<root>\n{body}</root>\n"), ("l.xml", body)):
        (d / name).write_text(text)
        f = read(spark, d / name, xml__objectOnEachLine="false" if name == "w.xml" else "true")
        assert f.schema() == [("_a", "string"), ("b", "string"), ("c", "string"), ("d", "string")]
        assert rows(f)[1] == ("3", "4", "c2", "d,2") and [r or "" for r in rows(f)[2]] == ["5", "", "", "d2"]
    write_source(f, {"xml.objectOnEachLine": "false"}, str(d / "o.xml"))
    assert (d / "o.xml").read_text() == f"<root>\n{body}</root>\n"


def test_parquet(spark, d):
    f = Frame(spark.createDataFrame([(1, 1.5, "x", None), (None, None, None, "y")], "a int, b float, c string, d string"), "t")
    write_source(f, {}, str(d / "t.parquet"))
    g = read(spark, d / "t.parquet")
    assert g.schema() == [("a", "integer"), ("b", "double"), ("c", "string"), ("d", "string")] and sorted(rows(g), key=repr) == sorted([(1, 1.5, "x", None), (None, None, None, "y")], key=repr)


def test_text(spark, d):
    (d / "t.log").write_text("abcd\nefgh\nijkl\n")
    assert rows(read(spark, d / "t.log")) == [("abcd", 1), ("efgh", 2), ("ijkl", 3)]
    with pytest.raises(SourceError):
        write_source(read(spark, d / "t.log"), {}, str(d / "o.txt"))


def test_folders_globs_and_compression(spark, d):
    many = d / "many"
    many.mkdir()
    for i in range(3):
        (many / f"f{i}.csv").write_text(CSV)
    assert read(spark, many).name == "many" and len(read(spark, f"{many}?format=csv")) == len(read(spark, many)) == 12
    assert len(read(spark, f"{many}/*.csv#m")) == 12 and read(spark, f"{many}/*.csv#m").name == "m"
    with pytest.raises(SourceError):
        read(spark, f"{many}/*.csv")
    (d / "g.csv.gz").write_bytes(gzip.compress(CSV.encode()))
    assert len(read(spark, d / "g.csv.gz")) == 4 and read(spark, d / "g.csv.gz").name == "g"
    with zipfile.ZipFile(d / "z.csv.zip", "w") as z:
        for i in range(3):
            z.writestr(f"e{i}.csv", CSV)
    assert len(read(spark, d / "z.csv.zip")) == 12 and read(spark, d / "z.csv.zip").columns == ["c1", "c2", "c3"]


def test_framed_snappy(spark, d):
    import pyarrow as pa

    raw = CSV.encode()
    packed = pa.Codec("snappy").compress(raw, asbytes=True)
    chunk = b"\x00\x00\x00\x00" + packed
    plain = b"\x00\x00\x00\x00" + raw
    framed = b"\xff\x06\x00\x00sNaPpY" + b"\x00" + len(chunk).to_bytes(3, "little") + chunk + b"\xfe\x02\x00\x00zz" + b"\x01" + len(plain).to_bytes(3, "little") + plain
    assert files.unframed(framed) == raw * 2
    (d / "s.csv.snappy").write_bytes(framed[: 10 + 4 + len(chunk)])
    assert len(read(spark, d / "s.csv.snappy")) == 4


def test_sqlite_source(spark, d):
    with sqlite3.connect(d / "x.db") as db:
        db.execute("create table t_123 (a text, b integer, c double, d boolean)")
        db.execute("insert into t_123 values ('1', 123, 123.123, false), (null, null, null, null)")
    f = read(spark, f"sqlite:{d}/x.db#t", db__query="select * from t_123")
    assert f.name == "t" and f.schema() == [("a", "string"), ("b", "integer"), ("c", "double"), ("d", "boolean")] and rows(f) == [("1", 123, 123.123, False), (None,) * 4]
    with pytest.raises(SourceError):
        read(spark, f"sqlite:{d}/x.db")
    with pytest.raises(SourceError):
        write_source(f, {}, f"sqlite:{d}/x.db")


def test_registry_takes_own_sources(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    register_source("mem", lambda s, loc, c: Frame(s.range(int(loc.path)), loc.name))
    assert len(read(spark, "mem://7#n")) == 7

    class Count(DataSource):
        @classmethod
        def name(cls):
            return "millrace_count"

        def schema(self):
            return "n int"

        def reader(self, schema):
            class R(DataSourceReader):
                def read(self, partition):
                    yield from ((i,) for i in range(3))

            return R()

    register_data_source(spark, Count, "count")
    assert len(read(spark, "count://x#c")) == 3


def test_queries_over_sources(spark, d):
    (d / "json1.json").write_text('[{"c1":1,"c2":"a","c3":"a1"},{"c1":2,"c2":"b","c3":"b1"},{"c1":3,"c2":"c","c3":"c3"},{"c1":4,"c2":"d","c3":"d4"}]')
    run = lambda q, **k: query_sources(spark, q, {"json.objectOnEachLine": "false"} | k, str(d / "json1.json"))
    assert rows(run("select * from json1 order by c1 desc"))[0][0] == 4.0
    for q, n in (("c1 > 2.0 and c2 = 'c'", 1), ("c3 match 'a'", 1), ("c3 like '%1'", 2), ("c3 regexp '.*1'", 2), ("c3 glob '[ab]*'", 2)):
        assert len(run(f"select * from json1 where {q}")) == n
    for q in ("select 1+1", "1+1"):
        assert query_sources(spark, q).columns == ["1+1"] and rows(query_sources(spark, q)) == [(2,)]
    f = Frame(spark.range(3), "r")
    assert rows(query_frames(spark, "select count(*) n from r a, r b", None, f)) == [(9,)]


def run_cli(spark, monkeypatch, capsys, stdin, *argv):
    monkeypatch.setattr(sys, "stdin", io.StringIO(stdin))
    code = main(list(argv), spark)
    return code, capsys.readouterr().out


def test_command_line(spark, d, monkeypatch, capsys):
    text = '[{"a":"1", "b":true,"c":1, "d":[1,2,3], "e": "[{\\"ea\\":1, \\"eb\\":2}, {\\"ea\\":3, \\"eb\\":4}]"}]'
    go = lambda *a, stdin=text: run_cli(spark, monkeypatch, capsys, stdin, *a)
    assert go("-output.std.type=json", "select json_array_length(d) as n from stdin", "-")[1] == '{"n":3}\n'
    assert sorted(go("-output.std.type=csv", 'select json_extract(value, "$.ea") as ea from stdin, json_each(stdin.e)', "-")[1].split()) == ["1", "3", "ea"]
    assert "c    double" in go('pragma table_info("stdin")', "-")[1].replace("  c ", "c ").replace("2  ", "") or "double" in go('pragma table_info("stdin")', "-")[1]
    code, out = go("select a, null as n from stdin", "-")
    assert code == 0 and out.splitlines()[0].split() == ["A", "N"] and out.splitlines()[2].split() == ["1", "<nil>"]
    assert go(f"-output={d}/o.json", "select a, c from stdin", "-")[0] == 0 and json.loads((d / "o.json").read_text()) == {"a": "1", "c": 1}
    assert go("-output.std.type=xml", "select a, c from stdin", "-")[1] == "<element><a>1</a><c>1</c></element>\n"
    assert go("-input.std.type=csv", "-output.std.type=csv", "select x from stdin where y = '2'", "-", stdin="x,y\n1,2\n3,4\n")[1] == "x\n1\n"
    assert go()[0] == 1 and go("select nope from stdin", "-")[0] == 1
    assert std.shown(None) == "<nil>" and std.shown(2.0) == "2"


@pytest.mark.parametrize("n", [3, 16, 17, 120])
def test_files_of_other_headers_merge_by_position(spark, tmp_path, n):
    """Whatever the number of files, columns go by position under the first file's names."""
    for i in range(n):
        (tmp_path / f"f{i:03}.csv").write_text(("x,y\n" if i % 2 == 0 else "y,x\n") + f"l{i},r{i}\n")
    df = read_sources(spark, {}, f"{tmp_path}/*.csv#f")[0].df
    assert df.columns == ["x", "y"] and sorted(map(tuple, df.collect())) == sorted((f"l{i}", f"r{i}") for i in range(n))


def test_parquet_files_of_other_schemas_merge_by_position(spark, tmp_path):
    for i in range(20):
        spark.range(i, i + 1).select(*([F.col("id").alias("a"), F.lit("s").alias("b")] if i % 2 == 0 else [F.col("id").alias("c"), F.lit("t").alias("d")])).coalesce(1).write.parquet(str(tmp_path / "w" / str(i)))
        next((tmp_path / "w" / str(i)).glob("part-*.parquet")).rename(tmp_path / f"p{i:02}.parquet")
    df = read_sources(spark, {}, f"{tmp_path}/*.parquet#p")[0].df
    assert df.columns == ["a", "b"] and sorted(map(tuple, df.collect())) == [(i, "st"[i % 2]) for i in range(20)]


def test_a_value_may_be_a_separator():
    assert parse("a.csv?csv.sep=;&x=1").options == {"csv.sep": ";", "x": "1"}
    assert parse("a.csv?csv.sep=%26;csv.hasHeader=false#n").options == {"csv.sep": "&", "csv.hasHeader": "false"}
    assert parse("a.csv?csv.sep=;").options == {"csv.sep": ";"}


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from millrace.session import shared_dir

    def session(master, folder=None, checkpoint=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint), conf=SimpleNamespace(get=lambda k, d=None: folder))

    assert shared_dir(session("yarn", "hdfs://x/c/")) == "hdfs://x/c" and shared_dir(session("yarn", None, "hdfs://x/d")) == "hdfs://x/d"
    assert shared_dir(session("local[4]")).startswith("file://")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared_dir(session(master))


def test_object_stores_by_url_and_options(spark):
    """Paths and credentials as the file systems get them; nothing is fetched."""
    assert parse("s3://bucket/a/b.csv").hadoop_path == "s3a://bucket/a/b.csv" and parse("gs://bucket/a.json#t").hadoop_path == "gs://bucket/a.json"
    options = parse("s3://b/x.csv?AWS_ACCESS_KEY_ID=k&aws_secret_access_key=s%2Fx&AWS_REGION=eu-1").options
    files._s3_options(spark, options)
    conf = spark._jsc.hadoopConfiguration()
    assert [conf.get(f"fs.s3a.{x}") for x in ("access.key", "secret.key", "endpoint.region")] == ["k", "s/x", "eu-1"]


@pytest.mark.parametrize(("url", "want"), [
    ("mysql:u:p@tcp(h:1)/d?db.query=select 1", {"url": "jdbc:mysql://h:1/d", "query": "select 1", "user": "u", "password": "p"}),
    ("postgres://u:p@h:5432/d?db.query=select a from t&partitionColumn=a&numPartitions=4", {"url": "jdbc:postgresql://h:5432/d?sslmode=disable", "query": "select a from t", "user": "u", "password": "p", "partitionColumn": "a", "numPartitions": "4"}),
])
def test_databases_get_query_login_and_options(spark, monkeypatch, url, want):
    from millrace.sources import rdbms

    class Reader:
        def __init__(self):
            self.got = {}

        def format(self, kind):
            assert kind == "jdbc"
            return self

        def option(self, k, v):
            self.got[k] = v
            return self

        def options(self, **more):
            self.got |= more
            return self

        def load(self):
            return spark.range(1).withColumnRenamed("id", "a")

    reader = Reader()
    frame = rdbms.read_rdbms(type("S", (), {"read": reader})(), parse(url))
    assert reader.got == want and frame.df.columns == ["a"]
    with pytest.raises(SourceError, match="query"):
        rdbms.read_rdbms(None, parse(url.partition("?")[0]))
