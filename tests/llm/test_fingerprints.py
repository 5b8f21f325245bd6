import hashlib
import math
import random
import re
import struct
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from millrace.llm import fingerprints as I


def edited(docs):
    """{id: (n, sha256 of the edited text)} by the rule."""
    order = sorted(docs)
    out = {}
    for i, (key, text) in enumerate(order):
        half = len(text) // 2
        new = text[: len(text) - half] + order[(i + 1) % len(order)][1][:half]
        out[key] = (len(text), hashlib.sha256(new.encode()).hexdigest(), new)
    return out


def terms(text):
    return {w for w in re.split(r"[^\w]+|_", text.lower()) if w}


def check(rows, docs):
    want = edited(docs)
    text = dict(docs)
    assert len(rows) == len(docs)
    by_text = {}
    for r in rows:
        n, sha, new = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        if new == text[r["doc_id"]]:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]


def test_query(spark, sf):
    docs = [(r[0], r[1] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = I.op1_imatch(spark, sf).collect()
    check(rows, docs)
    # different texts of other words have nothing in common
    assert sum(r["near_next"] == 1 for r in rows) <= sum(a[1] == b[1] for a, b in zip(sorted(docs), sorted(docs)[1:] + sorted(docs)[:1], strict=True))


def test_next_document_over_many_blocks(spark):
    keys = random.Random(1).sample(range(10**6), 800)
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in I.with_next(df, "doc_id", ["text"], block_rows=40).collect()}
    order = sorted(keys)
    assert got == {k: f"t{order[(i + 1) % len(order)]}" for i, k in enumerate(order)}


def test_lexicon_is_the_idf_band(spark):
    docs = [(i, " ".join(["all"] + (["half"] if i % 2 else []) + (["some"] if i % 20 == 0 else []) + [f"own{i}"])) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bits = I.lexicon(df, idf_band=(math.log(5), math.log(100))).collect()[0]["lexicon"]
    hashes = {w: spark.sql(f"select xxhash64('{w}')").first()[0] for w in ("all", "half", "some", "own3")}
    at = {w: (h % 2**64) >> (64 - I.LEXICON_BITS) for w, h in hashes.items()}
    held = {w: (bits[p >> 6] >> (p & 63)) & 1 for w, p in at.items()}
    assert held == {"all": 0, "half": 0, "some": 1, "own3": 0}
    assert len(bits) == 1 << (I.LEXICON_BITS - 6)


def h64(*parts):
    """Spark's xxhash64 of longs, ints and strings in turn."""
    seed = 42
    for x in parts:
        raw = x.encode() if isinstance(x, str) else struct.pack("<i", x[0]) if isinstance(x, tuple) else struct.pack("<q", x)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (seed >> 63 << 64)


def brute_terms(text):
    return sorted({h64(w) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w})


def brute_fingerprint(text, held):
    """Sorted lexicon terms, hashed by each sub-lexicon; all of them, or the text, where there are none."""
    kept = [h for h in brute_terms(text) if (h % 2**64) >> (64 - I.LEXICON_BITS) in held]
    every = h64(*kept) if kept else h64(text, (1,))
    draw, out = random.Random(I.SEED), []
    for k, p in enumerate(I.SUBSETS):
        mask = sum(1 << i for i in draw.sample(range(64 - I.LEXICON_BITS), p))
        part = [h for h in kept if h & mask == 0]
        out.append(h64(*part, (k,)) if part else every)
    return [*out, every]


def test_fingerprints_and_likeness_by_brute_force(spark, sf):
    docs = sorted((r[0], r[1] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    df = Counter(h for _, t in docs for h in brute_terms(t))
    lo, hi = len(docs) / math.exp(I.IDF_BAND[1]), max(1.0, len(docs) / math.exp(I.IDF_BAND[0]))
    held = {(h % 2**64) >> (64 - I.LEXICON_BITS) for h, n in df.items() if lo <= n <= hi}
    like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    hexed = lambda f: "".join(f"{x % 2**64:016x}" for x in f)
    fp, new = {k: brute_fingerprint(t, held) for k, t in docs}, edited(docs)
    rows = {r["doc_id"]: r for r in I.op1_imatch(spark, sf).collect()}
    for i, (k, _) in enumerate(docs):
        other = brute_fingerprint(new[k][2], held)
        r = rows[k]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(fp[k]), hexed(other)), k
        assert (r["near_edited"], r["near_next"]) == (like(fp[k], other), like(fp[k], fp[docs[(i + 1) % len(docs)][0]]))


def test_repeated_null_and_long(spark):
    rows = [(3, "b"), (3, "a"), (None, "n"), (4, "word " * 100_000), (5, "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, t string").withColumn("terms", F.lit(1)).repartition(2)
    got = I.edited_fingerprints(df).collect()
    assert len(got) == 5 and sorted(r["n_chars"] for r in got) == [1, 1, 1, 500_000, 3_000_000]
    lex = I.lexicon(df)
    assert I.fingerprint_columns(df, F.col("text"), lex, "fp").columns == [*df.columns, "fp"]


def test_likeness_falls_with_edits(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    docs, near = [], []
    for i in range(150):
        t = [rng.choice(words) for _ in range(200)]
        docs.append((i, " ".join(t)))
        near.append([" ".join(rng.choice(words) if rng.random() < p else w for w in t) for p in (0.0, 0.02, 0.1, 1.0)])
    df = spark.createDataFrame([(i, t, *n) for (i, t), n in zip(docs, near, strict=True)], "doc_id long, text string, a string, b string, c string, d string")
    lex = I.lexicon(df, idf_band=(0.0, math.log(2000)))
    out = I.fingerprint_columns(df, F.col("text"), lex, "f")
    for c in "abcd":
        out = I.fingerprint_columns(out, F.col(c), lex, f"f{c}")
    m = out.select(*[F.avg(I.likeness(F.col("f"), F.col(f"f{c}"))).alias(c) for c in "abcd"]).first()
    assert m["a"] == 1.0 > m["b"] > m["c"] > m["d"] and m["d"] < 0.01 and m["b"] > 0.4


def test_odd_rows(spark, odd_docs, no_docs):
    rows = I.edited_fingerprints(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["fingerprint"] for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (0, 1)}) == 1
    assert I.edited_fingerprints(no_docs).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    check(I.edited_fingerprints(one).collect(), [(5, "abcd")])


def test_no_python_and_no_cross_join(spark, sf):
    plan = I.op1_imatch(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
