"""Self-joins dealt out by blocks: the same rows as the plain join, in tasks of bounded size."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import frame
from millrace.plans import catalog
from millrace.plans.engine import run_sql
from millrace.plans.rewrite import self_joins, tokenize

JOIN = "from t a join t b on a.k = b.k"
QUERIES = [
    f"select a.id as x, b.id as y {JOIN}", "select x.id, y.id as j from t as x inner join t y on y.k == x.k and x.id < y.id", f"select a.g, count(*) as n, sum(b.id) as s {JOIN} group by a.g", f"select * {JOIN} where a.id % 3 = 0", f"select b.*, a.g {JOIN}",
    f"select distinct a.k, b.g {JOIN}", f"select count(*) n from (select a.id {JOIN} and a.g <> b.g) q", "select t.id x, b.id y from t join t b on t.K = b.k", f"select a.id x {JOIN} union all select b.id x {JOIN}",
]
PLAIN = [
    "select a.id x, b.id y from t a left join t b on a.k = b.k", f"{QUERIES[0]} or a.id = b.id", f"{QUERIES[0]} join t c on a.k = c.k", "select a.id x, b.id y from t a join u b on a.k = b.k",
    "with t as (select 1 id, 2 k) select a.id x, b.id y from t a join t b on a.k = b.k", "select a.id x, b.id y from t a join t b on a.k = b.id", f"select count(a.*) {JOIN}",
]


@pytest.fixture
def table(spark):
    # two large keys, one with copies of a row, small ones and nulls
    rows = [(i % 150, "big", "xyz"[i % 3]) for i in range(300)] + [(i, "mid", "x") for i in range(130)] + [(i, f"k{i % 40}", "z") for i in range(80)] + [(i, None, "y") for i in range(60)]
    return spark.createDataFrame(rows, "id int, k string, g string").repartition(3)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("q", QUERIES)
def test_blocks_give_the_rows_of_the_plain_join(spark, table, monkeypatch, q):
    tables = {"t": table}
    plain = run_sql(spark, q, tables)
    want, names = rows_of(plain), plain.columns
    monkeypatch.setattr(frame, "BLOCK", 20)
    monkeypatch.setattr(frame, "PAIRS", 2_000)
    got = run_sql(spark, q, tables)
    assert "_pair_right" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == names and rows_of(got) == want


@pytest.mark.parametrize("q", PLAIN)
def test_other_joins_are_left_alone(q):
    assert self_joins(tokenize(q), {"t": ["id", "k", "g"], "u": ["id", "k"]}) == []


def test_pairs_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frame, "BLOCK", 50)
    monkeypatch.setattr(frame, "PAIRS", 20_000)
    for n in (500, 2000):
        # one file and three keys, as of a small table: 83,000 and 1,300,000 pairs
        d = tmp_path / str(n)
        spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).cast("int").alias("s_nationkey")).coalesce(1).write.parquet(str(d / "supplier.parquet"))
        spark.range(1).write.parquet(str(d / "nation.parquet"))  # the query's text names it too
        df = catalog.queries()["join_self"](spark, str(d))
        tasks = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(tasks) == sum(len(range(r, n, 3)) ** 2 for r in range(3))
        assert max(tasks) <= 5 * frame.PAIRS and len(tasks) >= sum(tasks) / frame.PAIRS / 4
