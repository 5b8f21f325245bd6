import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import sharding as S


def test_draws_follow_the_law(spark):
    for t, k, n in ((20, 7, 9), (100, 40, 30), (3000, 1000, 200), (5, 5, 3), (4, 0, 2)):
        m = 4000
        got = Counter(r[0] for r in spark.range(m).select(S.hypergeometric(F.lit(t), F.lit(k), F.lit(n), S.uniform(F.col("id"), F.lit(t)))).collect())
        chi, cells = 0.0, 0
        rest_e = rest_g = 0.0
        for x in range(max(0, n + k - t), min(k, n) + 1):
            e = m * math.comb(k, x) * math.comb(t - k, n - x) / math.comb(t, n)
            if e >= 5:
                chi += (got[x] - e) ** 2 / e
                cells += 1
            else:
                rest_e, rest_g = rest_e + e, rest_g + got[x]
        assert sum(got.values()) == m and abs(rest_g - rest_e) < 6 * math.sqrt(rest_e) + 3
        assert chi < cells + 5 * math.sqrt(2 * cells), (t, k, n, chi, cells)


def test_matrix_sums(spark):
    sizes = [5, 0, 700, 13, 2, 2, 41, 9]
    cells = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "cell long, n long")
    got = {r[0]: r[1] for r in S.communication_matrix(cells, 3, 6, 1).collect()}
    assert [sum(got[i]) for i in range(8)] == sizes
    columns = [sum(c) for c in zip(*got.values(), strict=True)]
    assert sum(columns) == sum(sizes) and max(columns) - min(columns) <= 1


def check(rows, n):
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(shards.get(s, [])) for s in range(S.SHARDS)]
    assert len(rows) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = S.op4_hypergeometric(spark, sf).collect()
    check(rows, docs.count())
    want = {r[0]: (r[1] + 16, r[2]) for r in docs.select("doc_id", F.octet_length("text"), F.crc32("text")).collect()}
    assert all((r["size"], r["text_crc32"]) == want[r["doc_id"]] for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    check(S.assign(odd_docs, "doc_id").collect(), odd_docs.count())
    check(S.assign(no_docs, "doc_id").collect(), 0)
    named = odd_docs.withColumns({c: F.lit("x") for c in ("counts", "rid", "cell", "block", "n")}).withColumn("text", F.when(F.col("doc_id") == 4, F.repeat(F.lit("long "), 200_000)).otherwise(F.col("text")))
    got = S.assign(named, "doc_id")
    assert got.columns == [*named.columns, "shard", "slot"]
    assert sorted(map(str, got.drop("shard", "slot").collect())) == sorted(map(str, named.collect()))
    with pytest.raises(ValueError, match="overwritten"):
        S.assign(odd_docs.withColumn("Slot", F.lit(1)), "doc_id")
    same = spark.range(1000).select(F.lit(1).alias("doc_id"))
    check(S.assign(same, "doc_id").collect(), 1000)


def test_shuffle_is_uniform(spark):
    """Neighbours rarely stay together, and each shard gets its share of any part of the input."""
    rows = S.assign(spark.range(8000), "id").collect()
    first = Counter(r["shard"] for r in rows if r["id"] < 4000)
    assert all(60 < first[s] < 140 for s in range(S.SHARDS))
    place = {(r["shard"], r["slot"]): r["id"] for r in rows}
    kept = sum(place.get((s, k + 1)) == i + 1 for (s, k), i in place.items())
    assert kept < 20
