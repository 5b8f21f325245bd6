"""The streaming helpers give on a stream what they give on the same rows as a batch."""

import shutil

from pyspark.sql import functions as F

from millrace.streaming import events as E


def source(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    return spark.read.parquet(f"{sf}/events.parquet"), E.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_windows(spark, sf, tmp_path):
    batch, stream = source(spark, sf, tmp_path)
    assert stream.isStreaming
    for k, (size, slide) in enumerate((("6 hours", None), ("6 hours", "2 hours"))):
        make = lambda df, a=size, b=slide: E.windowed(df, "ts", ["event_type"], a, b, value="value")
        got = E.drain(make(stream), f"w{k}", f"file://{tmp_path}/c{k}")
        assert rows(got) == rows(make(batch)) and got.count() > 10


def test_sessions_close_behind_the_watermark(spark, sf, tmp_path):
    batch, stream = source(spark, sf, tmp_path)
    make = lambda df: E.sessions(df, "ts", "user_id", "30 minutes", late="0 seconds")
    got, want = set(rows(E.drain(make(stream), "s0", f"file://{tmp_path}/s", "append"))), set(rows(make(batch)))
    last = batch.agg(F.max("ts")).first()[0]
    assert got <= want and all(r[2] >= last for r in want - got)


def test_deduplication(spark, sf, tmp_path):
    batch, stream = source(spark, sf, tmp_path)
    twice = stream.union(stream)
    got = E.drain(E.deduplicated(twice, "ts", ["event_id"], late="60 days").select("event_id"), "d0", f"file://{tmp_path}/d", "append")
    assert got.count() == batch.count() == got.distinct().count()
