import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Reshare by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mix(spark, sf, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        rows = M.assign(docs)
        check(rows.collect(), docs.collect())
    assert M.assign(no_docs).count() == 0


def test_reruns_agree_and_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 5)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (sorted(map(tuple, M.op6_curriculum(spark, sf).collect())) for _ in range(2))
    assert a == b
    # the order and partitions of the input do not matter
    c = M.assign(docs.repartition(7).orderBy(F.desc("n_chars"))).select("doc_id", "taken").collect()
    assert sorted(map(tuple, c)) == sorted(map(tuple, M.assign(docs).select("doc_id", "taken").collect()))
    check(M.assign(docs).collect(), docs.collect())


def test_positions_invert_demand(spark):
    for slope in (-1.0, -0.5, 0.0, 0.5, 1.0):
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("u")).withColumn("t", M.position(F.col("u"), F.lit(slope))).collect()
        for r in rows:
            t = r["t"]
            assert 0 <= t <= 1 and t + slope * (t * t - t) == pytest.approx(r["u"], abs=1e-6)


def test_taken_and_positions_by_brute_force(spark, sf):
    """The random order is Spark's hash; sums, cuts and inverted demand are plain loops."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "source", "text", F.xxhash64(F.lit(M.SEED), "doc_id", "text").alias("k")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want, used, names = brute_targets(dict(sizes)), defaultdict(int), sorted(sizes, key=lambda s: (s is None, s))
    got = {r["doc_id"]: r for r in M.op6_curriculum(spark, sf).collect()}
    largest = max(sum(r["source"] == s for r in rows) for s in sizes)
    bits = max(2, math.ceil(math.log2(min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), largest))))

    def order(r):
        u = r["k"] % 2**64
        rest = (u << bits) % 2**64
        return u >> (64 - bits), rest - (rest >> 63 << 64), r["doc_id"]

    for r in sorted(rows, key=order):
        s, n = r["source"], len(WORD.findall(r["text"] or ""))
        slope, passes = M.SLOPES[names.index(s) % 3], []
        for i in range(3):
            at = i * sizes[s] + used[s]
            words = min(n, round(want[s]) - at)
            if words > 0:
                lo, hi = 0.0, 1.0
                for _ in range(60):
                    t = (lo + hi) / 2
                    lo, hi = (t, hi) if t + slope * (t * t - t) < at / want[s] else (lo, t)
                passes.append((words, lo))
        used[s] += n
        g = got[r["doc_id"]]
        assert g["taken"] == sum(w for w, _ in passes)
        assert g["positions"] == pytest.approx([t for _, t in passes], abs=1e-6)


def test_query_is_range_sorted(spark, sf):
    first = [r["position"] for r in M.op6_curriculum(spark, sf).collect()]
    there = [p for p in first if p is not None]
    assert there == sorted(there) and first[len(there) :] == [None] * (len(first) - len(there))


def test_schedule_is_sorted(spark, sf):
    rows = M.schedule(M.assign(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
